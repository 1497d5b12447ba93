"""Self-join on the Jaccard similarity of word n-grams with Bayesian pruning of candidates (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import blocks, components, cut, groups, mix, sets_of, stars, table, utf8

BANDS, ROWS = 32, 5
#: Hash values compared before each decision.
STEP = 16
#: Least and most documents on each side of one task that compares MinHash values, and of one that compares shingles;
#: larger buckets and components are dealt out as pairs of blocks, up to FEW of them on a side before blocks grow.
PRUNE_BLOCK, BLOCK, FEW = (512, 4096), (256, 2048), 16
#: Shingles in a block of texts, whatever its number of documents.
BLOCK_SHINGLES = 1 << 19


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (x[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[k:] >> np.uint64(32)).astype(np.uint32)


def minhash(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k 32-bit minima for each non-empty set."""
    at = np.cumsum([0] + [len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(17)).astype(np.uint32) if sets else np.empty(0, np.uint32)
    out = np.empty((len(sets), k), np.uint32)
    scratch = np.empty_like(flat)
    for j, (a, b) in enumerate(zip(*permutations(k), strict=True)):
        np.multiply(flat, a, out=scratch)
        scratch += b
        out[:, j] = np.minimum.reduceat(scratch, at[:-1]) if len(sets) else 0
    return out


def least_matches(threshold: float, tolerance: float, k: int, step: int) -> dict[int, int]:
    """For each number n of compared values, the fewest matches with which a pair is kept.

    With a uniform prior the similarity's posterior after m matches is Beta(m + 1, n - m + 1); a pair is dropped when
    it puts less than tolerance on threshold or more. Values are kept in 8 bits, so unlike ones match once in 256.
    """
    p = (np.arange(20_000) + 0.5) / 20_000
    high = p >= threshold + (1 - threshold) / 256
    out = {}
    for n in range(step, k + 1, step):
        for m in range(n + 1):
            x = m * np.log(p) + (n - m) * np.log1p(-p)
            x = np.exp(x - x.max())
            if x[high].sum() >= tolerance * x.sum():
                out[n] = m
                break
    return out


def survivors(left: np.ndarray, right: np.ndarray, least: dict[int, int], same: bool, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of left, rows of right) that no step drops; of the same rows each pair once.

    before has both sides' keys of the bands before this bucket's: a pair that shares one is met there.
    """
    found = []
    steps = sorted(least)
    for i in range(0, len(left), 64):
        head = (left[i : i + 64, None, :STEP] == right[None, :, :STEP]).sum(-1, dtype=np.int16)
        a, b = np.nonzero(head >= least[steps[0]])
        seen = head[a, b]
        a = a + i
        if same:
            keep = a < b
            a, b, seen = a[keep], b[keep], seen[keep]
        if before is not None:
            keep = ~(before[0][a] == before[1][b]).any(1)
            a, b, seen = a[keep], b[keep], seen[keep]
        for n in steps[1:]:
            seen = seen + (left[a, n - STEP : n] == right[b, n - STEP : n]).sum(-1, dtype=np.int16)
            keep = seen >= least[n]
            a, b, seen = a[keep], b[keep], seen[keep]
        found.append((a, b))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def dealt(rows: DataFrame, key: str, size: str, own: str, block: tuple[int, int], weight: str | None = None) -> DataFrame:
    """Give each row its tasks (key, lo, hi): one for a small group, else one for each pair of blocks with its own.

    A row goes out once for each block of its group, so blocks grow with the group up to the most that a task can hold;
    weight is the group's shingles, of which a block holds about BLOCK_SHINGLES at most.
    """
    least, most = block
    n = F.ceil(F.col(size) / F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col(size) / FEW))))
    if weight is not None:
        n = F.greatest(n, F.ceil(F.col(weight) / BLOCK_SHINGLES))
    rows = rows.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64(own), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks").withColumnRenamed(key, "task")


def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a task's two blocks; whether they are the same."""
    block, lo, hi = (group.column(c).to_numpy() for c in ("block", "lo", "hi"))
    if lo[0] == hi[0]:
        return np.arange(len(block)), np.arange(len(block)), True
    return np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0]), False


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left shares with each of right: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    values, inverse, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    column = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    row, column = row[shared], column[inverse[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        x = np.zeros((len(left) + len(right), width), np.float32)
        x[row[a:b], column[a:b] - first] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, copy_of, class_id, n_links, n_shingles.

    Two documents are linked if their sets of n-word shingles (words: runs without white space) have a Jaccard
    similarity of threshold or more. copy_of is the least id with the same set, class_id the least id that links lead
    to, n_links the number of other documents linked to this one. A text of fewer than n words has one shingle of them
    all; one of none, null ones included, has no links. Ids name documents: rows that repeat one should repeat its text.
    Rows with a null id are returned without links. Other columns are not read.

    Equal sets are one class and stand for their copies. Classes that share a band of MinHash values are candidates;
    of the buckets with the same members one is looked at, and a pair only in its first; there pairs of which the values compared so far leave no chance to reach threshold are dropped step by
    step. Within the components of what remains all pairs are verified exactly. Only counts and spanning edges leave a
    task, never pairs; buckets and components over a block's members are dealt out as pairs of blocks, so none is capped.
    A pair of similarity 0.8 shares no band with a probability of 3e-6.
    """
    k = BANDS * ROWS
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = mix(np.arange(1000, 1000 + k, dtype=np.uint64)).reshape(BANDS, ROWS)
        for batch in (x for b in batches for x in blocks(b, "text")):
            sets = sets_of(batch.column("text"), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            m = minhash([sets[i] for i in full], k)
            keys = mix((m.reshape(-1, BANDS, ROWS).astype(np.uint64) * c).sum(-1) + np.arange(BANDS, dtype=np.uint64))
            keys = (keys & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            one = np.array([sets[i].sum() for i in full], np.uint64).view(np.int64)
            two = np.array([mix(sets[i]).sum() for i in full], np.uint64).view(np.int64)
            sig = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((np.arange(len(full) + 1) * k).astype(np.int32)), pa.py_buffer((m & 0xFF).astype(np.uint8))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(full) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            where = np.full(len(sets), -1)
            where[full] = np.arange(len(full))
            at = pa.array(where, mask=where < 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x).take(at) for x in (one, two)), lists.take(at), sig.take(at)], ["id", "n", "one", "two", "keys", "sig"])

    s = cut(own.mapInArrow(sketch, f"id {kind}, n bigint, one bigint, two bigint, keys array<bigint>, sig binary"))
    classes = s.where("n > 0 and id is not null").groupBy("one", "two", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes)
    reps = s.join(classes.select(F.col("rep").alias("id"), "copies"), "id").select(F.col("id").alias("rep"), "copies", "keys", "sig")
    reps = cut(reps)

    banded = reps.select("rep", F.explode("keys").alias("key")).repartition("key")
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("first"), F.max("rep").alias("last")).where("m > 1")
    buckets = buckets.groupBy("m", "x", "first", "last").agg(F.min_by("key", F.col("key").bitwiseAND(BANDS - 1)).alias("key")).select("key", "m")
    tasks = dealt(banded.join(buckets, "key"), "key", "m", "rep", PRUNE_BLOCK).join(reps.select("rep", "sig", "keys"), "rep")
    least = least_matches(threshold, tolerance, k, STEP)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["task", "lo", "hi"]):
            group = group.combine_chunks()
            data, _ = utf8(group.column("sig"))
            sig = data.reshape(-1, k)
            left, right, same = sides(group)
            if not (len(left) and len(right)):  # a block without documents
                continue
            band = group.column("task")[0].as_py() & BANDS - 1
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :band]
            a, b = survivors(sig[left], sig[right], least, same, (keys[left], keys[right]))
            if len(a):
                label = stars(len(sig), left[a], right[b])
                part = np.flatnonzero(label != np.arange(len(sig)))
                yield pa.RecordBatch.from_arrays([group.column("rep").combine_chunks().take(pa.array(part)), group.column("rep").combine_chunks().take(pa.array(label[part]))], ["a", "b"])

    order = ["task", "lo", "hi"]
    edges = tasks.select(*order, "block", "rep", "sig", "keys").repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(prune, f"a {kind}, b {kind}")
    parts = components(edges)
    parts = parts.withColumnRenamed("id", "rep").join(classes.select("rep", "copies", "n"), "rep")
    sizes = parts.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    parts = parts.drop("n").join(sizes, "label")
    texts = own.join(parts, own["id"] == parts["rep"])
    work = dealt(texts.select("label", "m", "weight", "rep", "copies", "text"), "label", "m", "rep", BLOCK, "weight")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, order):
            names = group.column("rep").to_numpy()
            group = group.take(pa.array(np.flatnonzero(np.append(True, names[1:] != names[:-1])))).combine_chunks()
            left, right, same = sides(group)
            if not (len(left) and len(right)):
                continue
            sets = sets_of(group.column("text").combine_chunks(), n)
            size = np.array([len(x) for x in sets])
            copies = group.column("copies").to_numpy()
            shared = intersections([sets[i] for i in left], [sets[i] for i in right])
            link = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
            if same:
                np.fill_diagonal(link, False)
            count = np.zeros(len(sets), np.int64)
            count[left] += link @ copies[right]
            if not same:
                count[right] += copies[left] @ link
            a, b = np.nonzero(link)
            label = stars(len(sets), left[a], right[b])
            reps_ = group.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([reps_, pa.array(count), reps_.take(pa.array(label))], ["rep", "links", "to"])

    found = cut(work.select(*order, "block", "rep", "copies", "text").repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(verify, f"rep {kind}, links bigint, to {kind}"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = classes.join(links, "rep", "left").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("one", "two", "n", "rep", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = s.select("id", "one", "two", "n").join(known, ["one", "two", "n"], "left")
    real = F.col("id").isNotNull() & F.col("rep").isNotNull()
    pick = lambda x, other: F.when(real, F.col(x)).otherwise(other)
    return out.select(F.col("id").alias(id_col), pick("rep", F.col("id")).alias("copy_of"), pick("label", F.col("id")).alias("class_id"), pick("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
