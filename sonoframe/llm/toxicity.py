"""Toxicity by the nearest labelled examples under TF-IDF cosine, found with a block-max index (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import blocks, cut, hashed_words, mix, shingle_hashes, table, utf8

#: Labelled examples in the index, half of each class where there are so many: the bound of the sample that is fitted.
EXAMPLES = 4000
NEIGHBOURS = 32
BLOCK = 64
#: Terms of one in so many of the examples or more are a matrix.
COMMON = 20
#: Blocks that are searched before others are left out.
FIRST = 4


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of every start to stop, one range after the other, and how many each has."""
    n = stop - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class BlockMaxIndex:
    """Exact k nearest examples by cosine, over all words of the examples.

    Terms of one in COMMON examples or more are a matrix, whose part of the similarities is taken for many queries at
    once. All others have postings in blocks of BLOCK examples, and for each term and block the largest weight: a
    query's bound on a block is its weights times these and the most of the matrix' part there. The postings of the FIRST
    blocks by bound are added up, then those of all whose bound isn't below the k-th similarity by then.
    """

    def __init__(self, ids: list, labels: np.ndarray, weights: np.ndarray | tuple, share: np.ndarray, telling: np.ndarray | None = None, texts: np.ndarray | None = None):
        """weights: a normalised row per example, dense or as (row, term, weight); telling: a term's weight in votes.

        share is what an example stands for, as labels are sampled by class; texts are hashes of the whole texts.
        """
        row, term, value = weights if isinstance(weights, tuple) else (*np.nonzero(weights), weights[np.nonzero(weights)])
        width = weights.shape[1] if telling is None else len(telling)
        self.telling = np.ones(width) if telling is None else telling
        often = np.bincount(term, minlength=width)
        heavy = np.lexsort((-value, row))
        heavy = heavy[often[term[heavy]] >= max(2, len(ids) // BLOCK)]
        lead = np.full(len(ids), width)
        lead[row[heavy[::-1]]] = term[heavy[::-1]]
        order = np.argsort(lead, kind="stable")  # like ones in a block
        self.ids, self.labels, self.share = [ids[i] for i in order], labels[order], share[order]
        self.place = {} if texts is None else {int(h): i for i, h in enumerate(texts[order].tolist())}
        row = np.argsort(order)[row]
        by = np.lexsort((term, row))
        self.own_terms, self.own = term[by].astype(np.int32), np.searchsorted(row[by], np.arange(len(ids) + 1))
        self.own_weight = value[by]
        self.length = np.sqrt(np.bincount(row, (value * self.telling[term]) ** 2, len(ids)))
        common = np.flatnonzero(often >= max(2, len(ids) / COMMON))
        self.column = np.full(width, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(ids)))
        some = self.column[term] >= 0
        self.matrix[self.column[term[some]], row[some]] = value[some]
        self.told = np.ascontiguousarray((self.matrix * self.telling[common, None]).T)
        row, term, value = row[~some], term[~some], value[~some]
        by = np.lexsort((row, term))
        self.row, self.weight = row[by].astype(np.int32), value[by]
        self.blocks = np.arange(0, len(ids), BLOCK)
        cuts = np.flatnonzero(np.diff(term[by] * max(len(self.blocks), 1) + self.row // BLOCK, prepend=-1))
        self.block, self.start = self.row[cuts] // BLOCK, np.append(cuts, len(by))
        self.most = np.maximum.reduceat(self.weight, cuts) if len(cuts) else np.empty(0)
        self.first = np.searchsorted(term[by][cuts], np.arange(width + 1))
        blank = np.diff(self.own) == 0
        total = (self.share[blank]).sum()
        self.prior = float((self.share * self.labels).sum() / max(self.share.sum(), 1e-12)) if len(order) else 0.0
        self.blank = float(((self.share * self.labels)[blank].sum() + self.prior) / (total + 1))

    def by_matrix(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The matrix' part of the similarities of each query (terms, weights) to each example."""
        x = np.zeros((len(queries), len(self.matrix)))
        for i, (terms, query) in enumerate(queries):
            own = self.column[terms]
            x[i, own[own >= 0]] = query[own >= 0]
        return x @ self.matrix

    def nearest(self, terms: np.ndarray, query: np.ndarray, k: int, near: np.ndarray | None = None, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the k nearest examples with a similarity over 0, without one of them: places (ties by place), similarities,
        and what they share with the query where each word counts as it is telling."""
        if not len(self.ids):
            return np.empty(0, np.int64), np.empty(0), np.empty(0)
        near = self.by_matrix([(terms, query)])[0] if near is None else near
        if without is not None:
            near[without] = -np.inf
        told = np.zeros(len(near))
        kth = len(near) - min(k, len(near))
        entry, n = ranges(self.first[terms], self.first[terms + 1])
        by, block = np.repeat(np.stack([query, query * self.telling[terms] ** 2]), n, axis=1), self.block[entry]
        bound = np.maximum.reduceat(near, self.blocks) + np.bincount(block, self.most[entry] * by[0], len(self.blocks))
        first = np.zeros(len(bound), bool)
        first[np.argpartition(bound, -min(FIRST, len(bound)))[-FIRST:]] = True
        self.add(near, told, first, block, entry, by)
        least = np.partition(near, kth)[kth] - 1e-12
        self.add(near, told, ~first & (bound >= least), block, entry, by)
        some = np.flatnonzero((near > 0) & (near >= np.partition(near, kth)[kth] - 1e-12))
        sizes = np.round(near[some], 12)
        keep = np.argsort(-sizes, kind="stable")[:k]
        at, sizes = some[keep], sizes[keep]
        column = self.column[terms]
        some = column >= 0
        own = np.zeros(len(self.matrix))
        own[column[some]] = query[some] * self.telling[terms[some]]
        return at, sizes, told[at] + self.told[at] @ own

    def add(self, near: np.ndarray, told: np.ndarray, chosen: np.ndarray, block: np.ndarray, entry: np.ndarray, by: np.ndarray) -> None:
        """Add the postings of the chosen blocks, each weighted by its entry's two weights, to near and told."""
        some = np.flatnonzero(chosen[block])
        at, n = ranges(self.start[entry[some]], self.start[entry[some] + 1])
        row, weight, by = self.row[at], self.weight[at], np.repeat(by[:, some], n, axis=1)
        near += np.bincount(row, weight * by[0], len(near))
        told += np.bincount(row, weight * by[1], len(near))

    def vote(self, at: np.ndarray, shared: np.ndarray, terms: np.ndarray, query: np.ndarray) -> float:
        """Labels weighted by what the examples stand for and by nearness where each word counts as it is telling.

        That is c / (0.05 + 1 - c) of the cosine c with words times their telling. The prior is one far example.
        """
        c = np.minimum(shared / (np.linalg.norm(query * self.telling[terms]) * self.length[at]), 1)
        w = self.share[at] * c / (0.05 + 1 - c)
        far = 1 / (0.05 + 1)
        return float(((w * self.labels[at]).sum() + far * self.prior) / (w.sum() + far))

    def own_votes(self, places: np.ndarray, k: int) -> np.ndarray:
        """The votes on examples by all others."""
        out = np.full(len(places), self.blank)
        for some in batched(range(len(places)), 256):
            runs = [slice(self.own[places[i]], self.own[places[i] + 1]) for i in some]
            queries = [(self.own_terms[r], self.own_weight[r]) for r in runs]
            for i, (terms, query), part in zip(some, queries, self.by_matrix(queries), strict=True):
                at, _, shared = self.nearest(terms, query, k, part, int(places[i]))
                if len(at):
                    out[i] = self.vote(at, shared, terms, query)
        return out


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def platt(votes: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Slope and offset by which logits of votes give the chance of label 1, fitted by Newton's steps.

    Labels count as by Platt: a little inside 0 and 1, by the number of either, so that no slope is infinite. Without
    both labels, or where the slope wouldn't rise, votes stand as they are.
    """
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    if not ones or not zeros:
        return 1.0, 0.0
    goal = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([logit(votes), np.ones(len(votes))], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda w: (share * (np.logaddexp(0, x @ w) - goal * (x @ w))).sum() + 5e-4 * w @ w
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (goal - p)) - 1e-3 * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-10:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' words, in lower case and parted by white space, ASCII marks and “”«»…, and the rows' offsets."""
    data, at = utf8(pc.utf8_lower(column.fill_null("")))
    data = data.copy()
    for lead, after in ((b"\xe2\x80", b"\x9c\x9d\xa6"), (b"\xc2", b"\xab\xbb")):
        first = np.flatnonzero(data[: max(len(data) - len(lead), 0)] == lead[0])
        for k, byte in enumerate(lead[1:], 1):
            first = first[data[first + k] == byte]
        first = first[np.isin(data[first + len(lead)], np.frombuffer(after, np.uint8))]
        for k in range(len(lead) + 1):
            data[first + k] = 0x20
    return hashed_words(data, at, marks=True)


def term_counts(batch: pa.RecordBatch, text: str, terms: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row that has any: the row, which of the sorted terms, and how often."""
    own, rows = words(batch.column(text))
    row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
    where = np.searchsorted(terms, own)
    hit = np.flatnonzero(terms[np.minimum(where, len(terms) - 1)] == own) if len(terms) else np.empty(0, np.int64)
    if len(hit):
        pair, n = np.unique(row[hit] * len(terms) + where[hit], return_counts=True)
        cuts = np.flatnonzero(np.diff(pair // len(terms), prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pair)], strict=True):
            yield int(pair[a] // len(terms)), pair[a:b] % len(terms), n[a:b]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, BlockMaxIndex]:
    """Terms (sorted hashes of all words of the examples), their inverse document frequencies over all docs, and the index.

    A term's telling is 1 and the square of the standard errors by which its shares in the classes' texts differ, near
    copies counted once. Examples are distinct texts. Of each class the EXAMPLES / 2 with the least hash of their text
    are taken (more of one where the other has fewer), in that order, so that ids decide nothing; a share tells how many
    documents of its class one stands for.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", text_hash(F.col("text")))
    labelled = rows.select("id", "h").join(known, "id").groupBy("h").agg(F.max("label").alias("label"), F.min("id").alias("id"), F.count("*").alias("n"))
    labelled = cut(labelled)
    size = {r.label: r for r in labelled.groupBy("label").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()}
    texts, half = {c: size[c].texts if c in size else 0 for c in (0, 1)}, EXAMPLES // 2
    take = {c: min(texts[c], max(half, EXAMPLES - texts[1 - c])) for c in (0, 1)}
    picked = reduce(DataFrame.union, [labelled.where(F.col("label") == c).orderBy("h").limit(take[c]) for c in (0, 1)])
    picked = docs.sparkSession.createDataFrame(picked.select("h", "label", "id").toArrow())  # EXAMPLES rows at most
    sample = rows.select("h", "text").join(F.broadcast(picked), "h").dropDuplicates(["h"]).select("h", "id", "label", "text")

    kind = docs.schema[id_col].dataType.simpleString()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's distinct words and their counts, with its least shingle: near copies mostly have the same."""
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            own, rows_ = words(batch.column("text"))
            shingles, at = shingle_hashes(own, rows_, 5)
            runs = zip(rows_[:-1], rows_[1:], at[:-1], at[1:], strict=True)
            least = np.array([shingles[c:d].min() if d > c else mix(np.append(own[a:b], 0)).sum() for a, b, c, d in runs], np.uint64)
            each = [np.unique(own[a:b], return_counts=True) for a, b in zip(rows_[:-1], rows_[1:], strict=True)]
            lists = [pa.array([w[i].view(np.int64) for w in each], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "id", "label")), pa.array(least.view(np.int64)), *lists], ["h", "id", "label", "copies", "term", "n"])

    chosen = sample.mapInArrow(vectors, f"h bigint, id {kind}, label int, copies bigint, term array<bigint>, n array<bigint>").toArrow().sort_by("h").combine_chunks()
    flat = lambda c: chosen.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(chosen)), np.array([len(x) for x in chosen.column("term")], np.int64))
    terms, term = np.unique(flat("term").view(np.uint64), return_inverse=True)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(terms), np.int64), 0
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            total += batch.num_rows
            for _, at, _ in term_counts(batch, "text", terms):
                seen[at] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array(np.append(total, seen[some]))], ["at", "n"])

    everything = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = everything.mapInArrow(frequencies, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, np.int64)
    df[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    weight = (1 + np.log(flat("n"))) * idf[term]
    weight /= np.sqrt(np.bincount(row, weight**2, len(chosen)))[row]
    label = chosen.column("label").to_numpy().astype(np.float64)
    share = np.array([size[x].n / take[x] for x in chosen.column("label").to_pylist()], np.float64)
    copies = np.unique(chosen.column("copies").to_numpy(), return_inverse=True)[1] * 2 + label.astype(np.int64)
    once = np.unique(term * (2 * len(chosen) + 1) + copies[row]) if len(row) else np.empty(0, np.int64)
    of, toxic = once // (2 * len(chosen) + 1), once % (2 * len(chosen) + 1) % 2
    n1, n0 = (max(np.count_nonzero(np.unique(copies) % 2 == c), 1) for c in (1, 0))
    a, n = np.bincount(of, toxic, len(terms)), np.bincount(of, minlength=len(terms))
    spread = n / (n0 + n1) * (1 / n0 + 1 / n1)
    telling = 1 + (a / n1 - (n - a) / n0) ** 2 / spread
    index = BlockMaxIndex(chosen.column("id").to_pylist(), label, (row, term, weight), share / share.mean() if len(share) else share, telling, chosen.column("h").to_numpy())
    return terms, idf, index


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row per input row: id, score (0 to 1) and evidence, the nearest examples' ids, nearest first.

    Vectors have (1 + ln tf) * idf of all words of the EXAMPLES labelled documents; idf counts all documents. The nearest
    examples are exact. A word of no example adds to no similarity and is left out of a text's length, which changes no
    order. An example with the very same text is left out, so that no label enters its own row's score. Votes are
    calibrated by Platt's sigmoid, fitted to the votes of all others on each example.

    A text with none of the words, an empty or a null one, gets the labels' share among examples without any. Labels
    other than 0 and 1 are not used, of several for one text the highest is; without labels all scores are 0. Ids, null
    ones too, decide nothing; repeated rows are scored each; an empty table gives an empty result; other columns are not
    read.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    fitted = fit(docs, labels, id_col, text_col, label_col)
    model = sc.broadcast(fitted)  # EXAMPLES texts at most

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value[2].own_votes(batch.column(0).to_numpy(), neighbours))], ["id", "vote"])

    index = fitted[2]
    votes = spark.range(0, len(index.ids), 1, 12).mapInArrow(own, "id bigint, vote double").toArrow().sort_by("id") if len(index.ids) else None
    slope, offset = platt(votes.column("vote").to_numpy(), index.labels, index.share) if votes is not None else (1.0, 0.0)
    chance = lambda v: 1 / (1 + np.exp(-(slope * logit(v) + offset)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, index = model.value
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            votes, evidence = np.full(batch.num_rows, index.blank), [[] for _ in range(batch.num_rows)]
            same = [index.place.get(h) for h in batch.column("h").to_pylist()]
            for some in batched(term_counts(batch, "text", terms), 256):
                weights = [(1 + np.log(count)) * idf[at] for _, at, count in some]
                queries = [(at, w / np.linalg.norm(w)) for (_, at, _), w in zip(some, weights, strict=True)]
                for (row, _, _), (at, query), part in zip(some, queries, index.by_matrix(queries), strict=True):
                    near, _, shared = index.nearest(at, query, neighbours, part, same[row])
                    if len(near):
                        votes[row] = index.vote(near, shared, at, query)
                        evidence[row] = [index.ids[i] for i in near[:5].tolist()]
            scores = chance(votes) if len(index.ids) else votes
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores), pa.array(evidence, pa.list_(batch.schema.field("id").type))], [id_col, "score", "evidence"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text_hash(text).alias("h"), text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<{kind}>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~held(F.col("doc_id"))).select("doc_id", "toxic")
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
