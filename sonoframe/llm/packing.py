"""Cost-balanced packing of token sequences (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import Spreader, table

#: Documents whose remainders are packed together; bounds the memory of a packing task.
SHARD_DOCS = 4096


class Codec:
    """Token ids of a byte-level BPE in the tokenizers format.

    The merges run in tiktoken, which takes the same vocabulary as ranks and gives the same ids at four times the
    speed; a text that holds the string of an added token goes through tokenizers itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) of items shorter than capacity.

    As many sequences of the full capacity as the tokens fill, and for what is left one for each power of two in it, so
    that nothing is padded. Items go in descending order, each to the sequence of the lowest cost (linear * n +
    quadratic * n * n summed over its pieces) that can still hold it; items that none can hold are cut up to fill the
    gaps, the longest first.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic
    total = int(lengths.sum())
    room = [capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length(), -1, -1) if (total % capacity) >> k & 1]
    room, cost = np.array(room, np.int64), np.zeros(len(room))
    out, late = [], []

    def put(item: int, start: int, n: int, seq: int) -> None:
        out.append((item, start, n, seq))
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n

    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        if n:
            free = np.where(room >= n, cost, np.inf)
            seq = int(free.argmin())
            if free[seq] == np.inf:
                late.append(item)
            else:
                put(item, 0, n, seq)
    for item in late:
        start, n = 0, int(lengths[item])
        while start < n:
            seq = int(room.argmax())
            take = min(n - start, int(room[seq]))
            put(item, start, take, seq)
            start += take
    return out


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float | None = None) -> DataFrame:
    """Pack the token ids of all texts, each followed by end_id, into sequences of at most capacity tokens.

    Returns a row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. A document's whole multiples of capacity are sequences of their own, dealt over all tasks; its remainder is
    packed cost-balanced with those of about SHARD_DOCS other documents. Null texts are empty (one piece with end_id
    alone); repeated rows are packed each, rows with a null id like others; an empty table gives no rows; other columns
    are not read. docs should have the same rows in a partition each time, as files and checkpoints do.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    kind = docs.schema[id_col].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer, ranks)
        small = codec.whole.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        spread = Spreader()
        for batch in batches:
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 512):
                rows, starts, lengths, whole, shard, ids = [], [], [], [], [], []
                keys = spread(batch.column(2).slice(i, 512))
                for k, (text, key) in enumerate(zip(texts.slice(i, 512).to_pylist(), keys.tolist(), strict=True), i):
                    own = np.append(codec.ids(text or ""), np.uint32(end_id)).astype("<u2" if small else "<u4")
                    for start in range(0, len(own), capacity):
                        part = own[start : start + capacity]
                        rows.append(k)
                        starts.append(start)
                        lengths.append(len(part))
                        whole.append(len(own))
                        shard.append((key + start // capacity) % shards if len(part) == capacity else key % shards)
                        ids.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(whole, pa.int64()), pa.array(shard, pa.int64()), pa.array([small] * len(rows)), pa.array(ids, pa.binary())],
                    [id_col, "start", "length", "doc_tokens", "shard", "small", "ids"],
                )

    def place(piece: pa.Table) -> pa.Table:
        first = piece.column("shard")[0].as_py() << 32
        lengths = piece.column("length").to_numpy()
        starts = piece.column("start").to_numpy()
        full = np.flatnonzero(lengths == capacity)
        rest = np.flatnonzero(lengths < capacity)
        rest = rest[np.lexsort((starts[rest], -lengths[rest]))]
        cuts = [(r, 0, capacity, s) for s, r in enumerate(full.tolist())]
        cuts += [(int(rest[r]), start, n, seq + len(full)) for r, start, n, seq in assign(lengths[rest], capacity, linear, quadratic)]
        row, start, n, seq = np.array(cuts, np.int64).reshape(-1, 4).T
        filled: dict[int, int] = {}
        offsets = []
        for s, k in zip(seq.tolist(), n.tolist(), strict=True):
            offsets.append(filled.get(s, 0))
            filled[s] = offsets[-1] + k
        codes = "<u2" if piece.num_rows and piece.column("small")[0].as_py() else "<u4"
        ids = piece.column("ids")
        own = [np.frombuffer(ids[r].as_py(), codes)[a : a + k].astype("<u4").tobytes() for r, a, k in zip(row.tolist(), start.tolist(), n.tolist(), strict=True)]
        took = pa.array(row)
        return pa.table(
            [piece.column(id_col).take(took), pa.array(starts[row] + start), pa.array(n), pa.array(own, pa.binary()), piece.column("doc_tokens").take(took), pa.array(seq + first), pa.array(offsets, pa.int64())],
            [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    text = F.col(text_col).cast("string")
    # Shards follow from a row's content, its partition and its number among the partition's equal rows: many copies are
    # dealt over all shards, and a task that is run again deals its rows as it did before, in whatever order they come.
    pieces = docs.select(F.col(id_col), text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("_key")).mapInArrow(tokens, f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, shard bigint, small boolean, ids binary")
    return pieces.groupBy("shard").applyInArrow(place, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(table(spark, sf_dir, "documents"))


def pack_digest(docs: DataFrame) -> DataFrame:
    """What the contract asks for of the packed byte_bpe_50k pieces."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
