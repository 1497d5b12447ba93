"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import blocks, shingle_hashes, table, word_hashes
from sonoframe.llm.ngram_join import minhash, permutations

#: Bytes of item text in one index, which each executor holds; more items are searched for in as many passes.
INDEX_BYTES = 8 << 20
#: Hash functions. A band has one value, so one equal value makes a candidate.
VALUES = 128
SMALLEST = 8
#: Shingles of a long document whose windows are looked up at once; their values take 128 bytes each.
SPAN = 1 << 16


class Index:
    """Items by size class: class u holds those of u/2 to u shingles (the smallest all below)."""

    def __init__(self, ids: list, texts: pa.Array, n: int):
        words, rows = word_hashes(texts, marks=True)
        shingles, at = shingle_hashes(words, rows, n)
        sets = [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        full = [i for i, s in enumerate(sets) if len(s)]
        self.ids, self.sets = [ids[i] for i in full], [sets[i] for i in full]
        every = np.unique(np.concatenate(self.sets)) if full else np.empty(0, np.uint64)
        self.bits = max(16, int(len(every) * 4096).bit_length())
        self.bits = min(self.bits, 30)
        self.map = np.zeros(1 << self.bits - 3, np.uint8)
        self.every = every
        slot = every >> np.uint64(64 - self.bits)
        np.bitwise_or.at(self.map, slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        size = np.array([max(SMALLEST, 1 << (len(s) - 1).bit_length()) for s in self.sets], np.int64)
        values = minhash(self.sets, VALUES)
        self.classes = []
        for u in np.unique(size):
            own = np.flatnonzero(size == u)
            tables = []
            for j in range(VALUES):
                order = np.argsort(values[own, j], kind="stable")
                tables.append((values[own, j][order], own[order]))
            self.classes.append((int(u), tables))

    def near(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the shingles that an item has too: one in 4096 others passes the bit map, and is looked up."""
        slot = shingles >> np.uint64(64 - self.bits)
        some = np.flatnonzero(self.map[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
        where = np.searchsorted(self.every, shingles[some])
        return some[self.every[np.minimum(where, len(self.every) - 1)] == shingles[some]]

    def candidates(self, shingles: np.ndarray) -> list[int]:
        """Items that share a MinHash value with one of the document's windows, SPAN windows' starts at a time."""
        largest = self.classes[-1][0]
        span = max(SPAN, largest)
        found: set[int] = set()
        for first in range(0, len(shingles), span):
            found |= self._candidates(shingles[first : first + span + 2 * largest])
        return sorted(found)

    def _candidates(self, shingles: np.ndarray) -> set[int]:
        """For class u windows have three neighbouring blocks of u/2 shingles, so that a passage of an item's length lies
        within one, and the window's similarity to an item that is contained in it to 0.8 is 0.25 at least.
        """
        flat = (shingles >> np.uint64(17)).astype(np.uint32)
        found: set[int] = set()
        smallest = self.classes[0][0] // 2
        at = np.arange(0, len(flat), smallest)
        fine = np.empty((len(at), VALUES), np.uint32)
        for j, (a, b) in enumerate(zip(*permutations(VALUES), strict=True)):
            fine[:, j] = np.minimum.reduceat(flat * a + b, at)
        for u, tables in self.classes:
            low = np.minimum.reduceat(fine, np.arange(0, len(fine), u // 2 // smallest), axis=0)
            if len(low) > 2:
                low = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:])
            else:
                low = low.min(0, keepdims=True)
            for j, (values, items) in enumerate(tables):
                seen = low[:, j]
                first, last = np.searchsorted(values, seen, "left"), np.searchsorted(values, seen, "right")
                for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
                    found.update(items[a:b].tolist())
        return found


def contained(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item of which threshold or more of the n-word shingles are in the document.

    Returns id, item id, n_shared, n_item (distinct shingles of the item) and containment. Words are in lower case and
    parted by white space and ASCII marks, so that a passage is found in capitals or with marks strewn in. Items of fewer
    than n words have no shingle and are found nowhere; null and empty texts contain nothing; repeated rows of either side
    give a row each, rows with a null id like others; an empty table on either side gives no rows; other columns are not
    read. Long documents are looked through SPAN shingles at a time. Items are indexed INDEX_BYTES of text at a
    time, and each index is held against all documents whole, so neither side is capped; documents are not shuffled.
    """
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, n_shared bigint, n_item bigint, containment double"
    asked = items.select(F.col(item_id).alias("id"), F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("text"))
    passes = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // INDEX_BYTES)
    own = docs.select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("text"))
    found = []
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).orderBy("id", "text").toArrow()
        kind = part.schema.field("id").type
        index = spark.sparkContext.broadcast(Index(part.column("id").to_pylist(), part.column("text"), n))

        def search(batches: Iterator[pa.RecordBatch], index=index, kind=kind) -> Iterator[pa.RecordBatch]:
            x = index.value
            for batch in (b for whole in batches for b in blocks(whole, "text")):
                if not x.sets:
                    continue
                words, rows = word_hashes(batch.column("text"), marks=True)
                shingles, at = shingle_hashes(words, rows, n)
                doc, item, shared = [], [], []
                hit = np.searchsorted(at, x.near(shingles), "right") - 1
                for d in hit[np.flatnonzero(np.diff(hit, prepend=-1))].tolist():
                    mine = shingles[at[d] : at[d + 1]]
                    asked_ = x.candidates(mine)
                    mine = np.sort(mine) if asked_ else mine
                    for i in asked_:
                        where = np.searchsorted(mine, x.sets[i])
                        hits = int(np.count_nonzero(mine[np.minimum(where, len(mine) - 1)] == x.sets[i]))
                        if hits >= threshold * len(x.sets[i]) - 1e-9:
                            doc.append(d)
                            item.append(i)
                            shared.append(hits)
                size = np.array([len(x.sets[i]) for i in item], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([x.ids[i] for i in item], kind), pa.array(shared, pa.int64()), pa.array(size), pa.array(np.array(shared, np.float64) / np.maximum(size, 1))],
                    [id_col, item_id, "n_shared", "n_item", "containment"],
                )

        found.append(own.mapInArrow(search, schema))
    return reduce(DataFrame.union, found)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("containment", F.round("containment", 6))


OP2_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, list_slice(w, i, i + 4) as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
bs as (select distinct item_id, list_slice(w, i, i + 4) as s from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5)),
n as (select item_id, count(*) as n_item from bs group by item_id),
h as (select doc_id, item_id, count(*) as n_shared from ds join bs using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) as containment
from h join n using (item_id) where 10 * n_shared >= 8 * n_item
"""
