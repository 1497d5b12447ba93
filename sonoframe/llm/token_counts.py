"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both agree (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import table, utf8

#: A character that no piece holds: what follows it is encoded as if nothing stood before.
FENCE = "\n"


class ChunkedCounter:
    """Counts the tokens of a SentencePiece BPE model for a text of any length, some chunk + overlap characters at a time.

    A row of tokens is the encoding of its text if each two neighbours are the encoding of theirs: the first merge that
    crossed a boundary of the row would be the best one of the two tokens around it alone too, as the merges inside a
    token don't depend on what is beside it until then. So two encodings of overlapping chunks may be spliced at any
    token that both have at the same place: each pair of neighbours is from one of them. This needs no spaces, and
    tokens that a chunk's end has cut differ in the other chunk and so aren't common.

    The next chunk starts at a boundary of the last one, behind FENCE, so that texts that repeat a few characters are
    in step. Where two chunks have no token in common the overlap is doubled.
    """

    def __init__(self, model: str, chunk: int = 32_768, overlap: int = 512):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunk, self.overlap = chunk, overlap
        m, n = self.model, self.model.vocab_size()
        self.bytes = np.array([m.is_byte(i) for i in range(n)])
        self.inner = np.array([m.is_byte(i) and 0x80 <= int(m.id_to_piece(i)[1:-1], 16) < 0xC0 for i in range(n)])
        self.size = np.where(self.bytes, 1, [len(m.id_to_piece(i)) for i in range(n)])
        self.lead = int(self.size[m.encode("a")].sum()) - 1  # the space that the library puts before a text
        self.splits = self._merges() and self._keeps_text()

    def _merges(self) -> bool:
        """Whether the model is a BPE, whose scores are the ranks of merges, that spells what it lacks in bytes and has no
        piece over FENCE."""
        m = self.model
        own = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        whole = all(m.get_score(i) == int(m.get_score(i)) for i in own)
        return bool(self.bytes.sum() == 256) and whole and not any(FENCE in m.id_to_piece(i) for i in own)

    def _keeps_text(self) -> bool:
        """Whether the model's normaliser leaves runs of spaces, line ends and composed letters as they are."""
        probe = "a  b \n\tcéé ﬁ "
        return self.model.decode(self.model.encode(probe)) == probe

    def many(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk or not self.splits]
        counts = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            counts[i] = len(ids)
        for i in set(range(len(texts))) - set(short):
            counts[i] = self.long(texts[i])
        return counts

    def _encode(self, text: str, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each token of text[first:stop] begins and ends, in characters of text."""
        ids = np.array(self.model.encode(FENCE + text[first:stop] if first else text[first:stop]), np.int64)
        size = self.size[ids]
        # Of a character's byte tokens all but the last are empty at its start.
        size[:-1][self.bytes[ids[:-1]] & self.inner[ids[1:]]] = 0
        ends = np.cumsum(size) - self.lead
        begins = np.maximum(ends - size, 0)
        if first:
            begins, ends = begins[self.lead + 1 :] - 1, ends[self.lead + 1 :] - 1
        return begins + first, ends + first

    def long(self, text: str) -> int:
        total, cut, overlap = 0, 0, self.overlap
        stop = min(self.chunk, len(text))
        begins, ends = self._encode(text, 0, stop)
        while stop < len(text):
            before = begins[(begins > cut) & (begins <= stop - overlap)]
            if not len(before):  # the overlap has grown over the whole chunk: take it together with what follows
                stop = min(stop + overlap, len(text))
                begins, ends = self._encode(text, cut, stop)
                continue
            ahead = int(before[-1])
            following = min(ahead + overlap + self.chunk, len(text))
            b2, e2 = self._encode(text, ahead, following)
            at = self._splice(begins, ends, b2, e2)
            if at is None:
                overlap *= 2
                continue
            total += int(np.count_nonzero((begins >= cut) & (ends <= at)))
            cut, stop, overlap, begins, ends = at, following, self.overlap, b2, e2
        return total + int(np.count_nonzero(begins >= cut))

    @staticmethod
    def _splice(b1: np.ndarray, e1: np.ndarray, b2: np.ndarray, e2: np.ndarray) -> int | None:
        """The end of the last token that both encodings have."""
        first, second = e1 > b1, e2 > b2
        ends, i, j = np.intersect1d(e1[first], e2[second], return_indices=True)
        same = np.flatnonzero(b1[first][i] == b2[second][j])
        return int(ends[same[-1]]) if len(same) else None


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = 32_768, overlap: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens (as sentencepiece gives them for the whole text), over_limit.

    Null and empty texts have 0 tokens; repeated rows are counted each, rows with a null id like others; other columns
    are not read; an empty table gives an empty result. Texts over chunk characters are encoded chunk by chunk. Nothing
    is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkedCounter(model, chunk, overlap)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, at = utf8(texts)
            counts = [n for i in range(0, len(texts), 256) for n in counter.many(texts.slice(i, 256).to_pylist())]
            counts = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), counts, pc.greater(counts, limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
