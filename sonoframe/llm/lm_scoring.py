"""Stupid-backoff scores of documents under the n-gram counts of all the others (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import Spreader, blocks, mix, table, word_hashes

#: Bytes of text in a block.
BLOCK = 4 << 20
#: 1 << FAN_BITS buckets are dealt to by one sender, and as many senders are taken together at each level of the table.
FAN_BITS = 8


def grams(words: np.ndarray, rows: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to order, a hash of the words up to each place; 0 where the row has too few before it."""
    place = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
    out, h = [], np.zeros(len(words), np.uint64)
    for k in range(order):
        h = h.copy()
        h[k:] += words[: len(words) - k] * np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 3, 1 << 64))
        own = mix(h + np.uint64(k + 1)) | np.uint64(1)
        out.append(np.where(place >= k, own, np.uint64(0)))
    return out


def packed(x: np.ndarray, kind: str) -> bytes:
    """Integers as compressed bytes, the highest byte of all first: these are mostly 0."""
    raw = x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of hashes with 0 for none: where the others are, the distinct ones in order, each one's number among
    these, and how often each is there."""
    real = np.flatnonzero(h)
    own = h[real]
    order = np.argsort(own)
    own = own[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    number = np.empty(len(own), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return real, own[first], number, np.diff(np.append(first, len(own)))


def others(n: int, row: np.ndarray, real: np.ndarray, number: np.ndarray, here: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each of n places the count of its n-gram in other documents than its own.

    Of an n-gram that is once in the block its document has one; only the others are counted by document.
    """
    out = np.zeros(n, np.int64)
    out[real] = totals[number] - 1
    more = np.flatnonzero(here[number] > 1)
    key = row[real[more]] * len(here) + number[more]
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    out[real[more[order]]] -= size[np.cumsum(new) - 1] - 1 if len(key) else 0
    return out


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """df dealt by keys, over more partitions than the session has where there are many groups of about BLOCK bytes."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(groups // 16, *keys) if groups // 16 > usual else df.repartition(*keys)


def stupid_backoff(docs: DataFrame, order: int = 3, discount: float = 0.4, unseen: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_words, n_order_1 ... n_order_N, score and mean_score (null without words).

    score is the sum over the words of ln S, where S is c(context word) / c(context) for the longest context of up to
    order - 1 words with a count over 0, times discount for each word by which the context had to be shortened. Counts
    are those of all other documents: a document's own are taken off. The shortest context has c(word) over all words,
    and a word that no other document has counts as unseen. n_order_k counts the words that a k-gram decided.

    Every block of documents sends the hashes of its distinct n-grams to the hash buckets of the count table, sorted and
    packed; each bucket sums its counts and sends the blocks theirs; a block then joins them to its n-grams and sums up
    each document's. A block has 1 << FAN_BITS messages at any size of the corpus: where there are more blocks than that,
    as many are summed up by bucket first, and the sums go on, as one sender's, to as many smaller buckets each, until
    a bucket hears no more senders than that. So messages are as many as blocks, times the levels. Lengths 1 and 2 go first. A longer n-gram is only asked for where both n-grams one shorter in it
    are in other documents too, as it can't be otherwise. An n-gram comes once from each block, so frequent ones make no
    large bucket. Words are runs without
    white space. Null and empty texts have no words; repeated rows are documents of their own, dealt over all blocks; rows
    with a null id are scored like others; an empty table gives an empty result; other columns are not read. docs should
    have the same rows in a partition each time, as files and checkpoints do.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    size = own.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(n_words).alias("words")).first()
    parts, corpus = max(1, -(-(size.bytes or 0) // BLOCK)), size.words or 0
    stored = own.withColumn("key", F.xxhash64("id", F.crc32(F.encode("text", "UTF-8"))))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of a block together and compressed, as they go over the network."""
        spread_ = Spreader()
        for batch in (b for whole in batches for b in blocks(whole, "text", 4 << 20)):
            block = (spread_(batch.column("key")) % np.uint64(parts)).astype(np.int64)
            order_ = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order_], prepend=-1))
            squeeze = zstandard.ZstdCompressor(level=3)
            blobs = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)], strict=True):
                piece = batch.select(["id", "text"]).take(pa.array(order_[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_batch(piece)
                blobs.append(squeeze.compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(block[order_][cuts]), pa.array(blobs, pa.binary())], ["block", "docs"])

    def texts(column: pa.ChunkedArray) -> pa.Table:
        read = [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x.as_py())).read_all() for x in column]
        return pa.concat_tables(read).combine_chunks()

    def hashed(docs_: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        words, rows, first = [], [np.zeros(1, np.int64)], 0
        for piece in docs_.to_batches():
            for b in blocks(piece, "text"):
                w, r = word_hashes(b.column("text"))
                words.append(w)
                rows.append(r[1:] + first)
                first += len(w)
        words_, rows_ = np.concatenate(words) if words else np.empty(0, np.uint64), np.concatenate(rows)
        return grams(words_, rows_, order), rows_

    def lengths(step: int) -> slice:
        """The n-gram lengths (less 1) that round step asks for."""
        return slice(0, 2) if step == 0 else slice(step + 1, step + 2)

    def narrow(n_grams: list[np.ndarray], counts: list[np.ndarray], step: int) -> None:
        """Leave of the n-grams of a later round those that can be in another document."""
        if 0 < step and step + 1 < len(n_grams):
            possible = counts[step] > 0
            possible[1:] &= counts[step][:-1] > 0
            possible[:1] = False
            n_grams[step + 1] = np.where(possible, n_grams[step + 1], np.uint64(0))

    def known(docs_: pa.Table, right: pa.Table, steps: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """From the answers to the first rounds: hashes by length (0 where one isn't asked for), counts, row offsets."""
        n_grams, rows = hashed(docs_)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        counts: list[np.ndarray] = []
        for step in range(steps):
            mine = right.filter(pa.compute.equal(right.column("step"), step)).sort_by("bucket")
            totals = np.concatenate([unpacked(x.as_py(), ">u8") for x in mine.column("totals")] or [np.empty(0, np.uint64)]).astype(np.int64)
            own_ = [numbered(h) for h in n_grams[lengths(step)]]
            every = np.sort(np.concatenate([distinct for _, distinct, _, _ in own_]))  # answers come in this order
            every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
            for real, distinct, number, here in own_:
                at = np.arange(len(every)) if len(distinct) == len(every) else np.searchsorted(every, distinct)
                counts.append(others(len(row), row, real, number, here, totals[at]))
            narrow(n_grams, counts, step + 1)
        return n_grams, counts, rows

    def message(sender: int, every: np.ndarray, count: np.ndarray, level: int) -> pa.Table:
        """A row for each bucket of the level: its share of sorted hashes, as differences, and their counts."""
        bucket = (every >> np.uint64(64 - FAN_BITS * level)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts.tolist(), len(every)][1:]
        return pa.table(
            [pa.array(bucket[cuts]), pa.array([sender] * len(cuts), pa.int64()), pa.array([packed(np.diff(every[a:b], prepend=np.uint64(0)), ">u8") for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([packed(count[a:b], ">u8") for a, b in zip(cuts, ends, strict=True)], pa.binary())],
            ["bucket", "sender", "hashes", "counts"],
        )

    def requests(block: int, n_grams: list[np.ndarray], step: int) -> pa.Table:
        every = np.sort(np.concatenate(n_grams[lengths(step)]))
        every = every[np.searchsorted(every, 1) :]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
        return message(block, every[first], np.diff(np.append(first, len(every))), 1)

    def summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Of all messages of a group: distinct hashes, their counts, each sent hash's number, and where messages end."""
        hashes = [np.cumsum(unpacked(x.as_py(), ">u8").astype(np.uint64), dtype=np.uint64) for x in group.column("hashes")]
        counts = np.concatenate([unpacked(x.as_py(), ">u8") for x in group.column("counts")]).astype(np.int64)
        flat = np.concatenate(hashes)
        order_ = np.argsort(flat)
        new = np.append(True, flat[order_][1:] != flat[order_][:-1])
        number = np.empty(len(flat), np.int64)
        number[order_] = np.cumsum(new) - 1
        return flat[order_][new], np.add.reduceat(counts[order_], np.flatnonzero(new)), number, np.cumsum([len(h) for h in hashes]).tolist()

    def reply(group: pa.Table, totals: np.ndarray, ends: list[int], step: int) -> pa.Table:
        out = [packed(totals[a:b], ">u8") for a, b in zip([0, *ends], ends)]
        return pa.table([group.column("bucket"), group.column("sender"), pa.array(out, pa.binary()), pa.array([step] * len(out), pa.int64())], ["bucket", "sender", "totals", "step"])

    def answers(step: int):
        def run(group: pa.Table) -> pa.Table:
            _, total, number, ends = summed(group)
            return reply(group, total[number], ends, step)

        return run

    def upwards(level: int):
        def run(group: pa.Table) -> pa.Table:
            every, total, _, _ = summed(group)
            return message(group.column("node")[0].as_py(), every, total, level + 1)

        return run

    def downwards(step: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            _, _, number, ends = summed(left)
            right = right.sort_by("bucket")
            total = np.concatenate([unpacked(x.as_py(), ">u8") for x in right.column("totals")]).astype(np.int64)
            return reply(left, total[number], ends, step)

        return run

    def resolved(asked: DataFrame, senders: int, level: int, step: int) -> DataFrame:
        """Each message's totals over the whole corpus, from senders numbered below senders."""
        schema = "bucket bigint, sender bigint, totals binary, step bigint"
        if senders <= 1 << FAN_BITS:
            return asked.groupBy("bucket").applyInArrow(answers(step), schema)
        asked = spread(asked.withColumn("node", F.shiftright("sender", FAN_BITS)), senders >> FAN_BITS, "bucket", "node")
        above = asked.groupBy("bucket", "node").applyInArrow(upwards(level), "bucket bigint, sender bigint, hashes binary, counts binary")
        above = resolved(above, (senders - 1 >> FAN_BITS) + 1, level + 1, step)
        above = spread(above.select(F.col("bucket").alias("own"), F.shiftright("bucket", FAN_BITS).alias("bucket"), F.col("sender").alias("node"), "totals"), senders >> FAN_BITS, "bucket", "node")
        return asked.groupBy("bucket", "node").cogroup(above.withColumnRenamed("bucket", "under").withColumnRenamed("own", "bucket").groupBy("under", "node")).applyInArrow(downwards(step), schema)

    def ask(group: pa.Table) -> pa.Table:
        n_grams, _ = hashed(texts(group.column("docs")))
        return requests(group.column("block")[0].as_py(), n_grams, 0)

    def ask_longer(step: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            n_grams, _, _ = known(texts(left.column("docs")), right, step)
            return requests(left.column("block")[0].as_py(), n_grams, step)

        return run

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_ = texts(left.column("docs"))
        _, counts, rows = known(docs_, right, rounds)
        n = np.diff(rows)
        row = np.repeat(np.arange(len(n)), n)
        top = np.minimum(np.arange(len(row)) - np.repeat(rows[:-1], n), order - 1)
        used = np.zeros(len(row), np.int64)
        for k in range(1, order):
            used[counts[k] > 0] = k
        before = np.maximum(corpus - n, 1)[row].astype(np.float64)
        this = np.maximum(counts[0], unseen).astype(np.float64)
        for k in range(1, order):
            at = np.flatnonzero(used == k)
            this[at], before[at] = counts[k][at], counts[k - 1][at - 1]
        s = np.log(this / before) + (top - used) * np.log(discount)
        sums = np.bincount(row, s, len(n)).astype(np.float64)
        hits = [np.bincount(row[used == k], minlength=len(n)) for k in range(order)]
        empty = n == 0
        return pa.table(
            [docs_.column("id"), pa.array(n), *(pa.array(h) for h in hits), pa.array(sums, mask=empty), pa.array(sums / np.maximum(n, 1), mask=empty)],
            [id_col, "n_words", *(f"n_order_{k + 1}" for k in range(order)), "score", "mean_score"],
        )

    rounds = max(order - 1, 1)
    by_block = spread(stored.mapInArrow(store, "block bigint, docs binary"), parts, "block")
    sent = "bucket bigint, sender bigint, hashes binary, counts binary"
    asked = by_block.groupBy("block").applyInArrow(ask, sent)
    answered = None
    for step in range(rounds):
        if step:
            asked = by_block.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask_longer(step), sent)
        new = spread(resolved(asked, parts, 1, step).withColumnRenamed("sender", "block"), parts, "block")
        answered = new if answered is None else answered.union(new)
    schema = f"`{id_col}` {kind}, n_words bigint, {', '.join(f'n_order_{k + 1} bigint' for k in range(order))}, score double, mean_score double"
    return by_block.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("score", "mean_score")})


OP1_SQL = r"""
with w0 as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
t as (select doc_id, i, w[i] as w3, case when i > 1 then w[i - 1] end as w2, case when i > 2 then w[i - 2] end as w1 from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w0)),
c1 as (select w3, count(*) as n from t group by all), o1 as (select doc_id, w3, count(*) as n from t group by all),
c2 as (select w2, w3, count(*) as n from t where i > 1 group by all), o2 as (select doc_id, w2, w3, count(*) as n from t where i > 1 group by all),
c3 as (select w1, w2, w3, count(*) as n from t where i > 2 group by all), o3 as (select doc_id, w1, w2, w3, count(*) as n from t where i > 2 group by all),
l1 as (select doc_id, w3, c1.n - o1.n as n from o1 join c1 using (w3)),
l2 as (select doc_id, w2, w3, c2.n - o2.n as n from o2 join c2 using (w2, w3)),
l3 as (select doc_id, w1, w2, w3, c3.n - o3.n as n from o3 join c3 using (w1, w2, w3)),
size as (select count(*) as n from t), own as (select doc_id, count(*) as n from t group by all),
s as (select t.doc_id, least(t.i, 3) as top, u.n as n1, coalesce(b.n, 0) as n2, coalesce(g.n, 0) as n3, x.n as x1, y.n as x2, size.n - own.n as rest
  from t join size on true join own on own.doc_id = t.doc_id
  join l1 u on u.doc_id = t.doc_id and u.w3 = t.w3
  left join l2 b on b.doc_id = t.doc_id and b.w2 = t.w2 and b.w3 = t.w3
  left join l3 g on g.doc_id = t.doc_id and g.w1 = t.w1 and g.w2 = t.w2 and g.w3 = t.w3
  left join l1 x on x.doc_id = t.doc_id and x.w3 = t.w2
  left join l2 y on y.doc_id = t.doc_id and y.w2 = t.w1 and y.w3 = t.w2),
r as (select doc_id, case when n3 > 0 then 3 when n2 > 0 then 2 else 1 end as k,
  case when n3 > 0 then ln(n3 / x2) when n2 > 0 then ln(n2 / x1) + (top - 2) * ln(0.4) else ln(greatest(n1, 0.5) / greatest(rest, 1)) + (top - 1) * ln(0.4) end as s from s)
select d.doc_id, count(r.k) as n_words, count(*) filter (k = 1) as n_order_1, count(*) filter (k = 2) as n_order_2, count(*) filter (k = 3) as n_order_3,
  round(sum(s), 6) as score, round(avg(s), 6) as mean_score
from documents d left join r on r.doc_id = d.doc_id group by d.doc_id
"""
