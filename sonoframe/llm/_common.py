"""Helpers shared by the corpus operators: tables, lineage cuts, and vectorised text hashing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.operators.shared import cut, stored  # noqa: F401

#: Bytes of text that the numpy helpers take at once; their scratch arrays hold about 60 bytes for each.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Arrow batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one row after the other, and the rows' offsets in them (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about limit bytes of text; a longer row is a run of its own."""
    _, at = utf8(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(at, at[first] + limit, "right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys in a stream of batches that is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            if held:
                new[0] |= x[0] != held[-1].column(k)[-1].as_py()
        cuts = np.flatnonzero(new)
        start = 0
        for c in cuts:
            if c:
                held.append(batch.slice(start, c - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], int(c)
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Spreader:
    """Keys that tell equal rows of a partition apart, by their number among these, so that many copies aren't one key.

    A task that is run again on the same rows gives the same keys, in whatever order equal rows come.
    """

    def __init__(self):
        self.part, self.seen = np.uint64(TaskContext.get().partitionId() << 32), Counter()

    def __call__(self, keys: pa.Array) -> np.ndarray:
        copy = []
        for key in keys.to_pylist():
            copy.append(self.seen[key])
            self.seen[key] += 1
        return mix(keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + mix(np.array(copy, np.uint64) + self.part)) >> np.uint64(1)


# ---------------------------------------------------------------- hashing

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit number for each byte value, from a counter, so that every worker has the same.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which range_hash gives any substring's hash; one longer than data."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_CODES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop]; equal strings have equal ones wherever they stand."""
    raw = (prefix[stop] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
    return mix(raw + (stop - start).astype(np.uint64) * _GOLD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Everything in ASCII but letters and digits.
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(128) if not chr(i).isalnum()]] = True


def word_bounds(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run without breaks (white space, [\\x20\\x09-\\x0D]), and the words before each row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(column: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of a string column, row after row, and the rows' offsets among them.

    With marks, marks part words as white space does.
    """
    return hashed_words(*utf8(column), marks)


def hashed_words(data: np.ndarray, at: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of the rows data[at[i]:at[i+1]]."""
    breaks = _MARKS if marks else _SPACE
    if len(data) > 2 * BLOCK_BYTES:
        return _long_hashes(data, at, breaks)
    start, end, rows = word_bounds(data, at, breaks)
    if not len(start):
        return np.empty(0, np.uint64), rows
    return range_hash(prefix_hash(data), start, end), rows


def _long_hashes(data: np.ndarray, at: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of BLOCK_BYTES at a time: a word that goes on in the next block takes up its hash from there."""
    raws, sizes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    goes_on = False
    for first in range(0, len(data), BLOCK_BYTES):
        own = data[first : first + BLOCK_BYTES]
        marks = at[np.searchsorted(at, first) : np.searchsorted(at, first + len(own))] - first
        start, end, _ = word_bounds(own, np.append(marks, len(own)), breaks)
        prefix = prefix_hash(own)
        raw = (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]
        size = (end - start).astype(np.uint64)
        skip = 0
        if goes_on and len(start) and not start[0] and not (len(marks) and not marks[0]):
            raws[-1][-1:] += raw[:1] * np.uint64(pow(_BASE, int(sizes[-1][-1]), 1 << 64))
            sizes[-1][-1:] += size[:1]
            skip = 1
        if len(start) > skip:
            raws.append(raw[skip:])
            sizes.append(size[skip:])
            starts.append(start[skip:] + first)
        goes_on = bool(len(end)) and int(end[-1]) == len(own)
    return mix(np.concatenate(raws) + np.concatenate(sizes) * _GOLD), np.searchsorted(np.concatenate(starts), at)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each row, and the rows' offsets among them."""
    counts = np.maximum(np.diff(rows) - (n - 1), 0)
    at = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=at[1:])
    if not at[-1]:
        return np.empty(0, np.uint64), at
    total = len(words) - n + 1
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out += words[k : k + total] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    first = np.repeat(rows[:-1] - at[:-1], counts) + np.arange(at[-1])
    return mix(out[first]), at


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each row, sorted; a row of fewer words has one of all of them, if any."""
    words, rows = word_hashes(column)
    shingles, at = shingle_hashes(words, rows, n)
    out = []
    for a, b, v, w in zip(at[:-1].tolist(), at[1:].tolist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b > a:
            x = np.sort(shingles[a:b])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            own = words[v:w]
            out.append(mix(np.cumsum(own * (np.arange(1, len(own) + 1, dtype=np.uint64) * _GOLD))[-1:]))
    return out


# ---------------------------------------------------------------- graphs


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of n nodes' components, given edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): each node as id with its component's least node as label.

    Each round takes the least label among the neighbours and then that label's own label, so chains halve. Labels
    stay on the executors and are checkpointed each round; one row per node, a hub's edges are pre-aggregated.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("label")))
    while True:
        said = both.join(label, both["b"] == label["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        new = label.join(said, "id").select("id", "label", F.least("label", "heard").alias("low"))
        hop = label.select(F.col("id").alias("low"), F.col("label").alias("lower"))
        new = cut(new.join(hop, "low").select("id", F.col("label").alias("was"), F.col("lower").alias("label")))
        done = new.where("was <> label").isEmpty()
        label = new.select("id", "label")
        if done:
            return label
