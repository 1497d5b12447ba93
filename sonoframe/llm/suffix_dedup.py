"""Removal of byte strings that repeat across a corpus, by sorting suffix buckets over a cover sample (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm._common import blocks, mix, prefix_hash, range_hash, table, utf8

#: Bytes of the strings that sample places are chosen by.
GRAM = 50
#: Low bits of a sort key that hold the place; the rest orders the strings.
PLACE_BITS = 28
#: Bytes of a long text whose strings are sampled at once; at most 1 << PLACE_BITS less a string's length.
PIECE_BYTES = 4 << 20
#: Contexts of one sample string that are sorted in one task; those of a more frequent string are dealt by hash.
LARGE = 4096
#: Bytes of contexts sorted at once, and rows held of one sample string before it counts as a large one.
SORT_BYTES, HELD_ROWS = 1 << 20, 200_000
#: Shares into which the strings of a bucket over HELD_ROWS are dealt, whose size isn't known when its first rows pass.
STREAM_SHARDS = 4096


def cover(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The cover sample of the rows data[at[i]:at[i+1]].

    Each string of length bytes is given a place in it that depends on its bytes alone: that of its least substring of
    GRAM bytes (by hash; of equal ones the first). Equal strings so meet at the same place, as suffixes do under a
    difference cover. Returns for each place: row, hash of the substring there, first and last start of the strings
    that chose it, and the hash of all the bytes of these.
    """
    none = np.empty(0, np.int64)
    starts = len(data) - length + 1
    if starts <= 0:
        return none, none.view(np.uint64), none, none, none.view(np.uint64)
    prefix = prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (range_hash(prefix, place, place + GRAM) & ~low) | place.astype(np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    size = np.diff(at)
    long = size >= length
    edge = np.zeros(starts + 1, np.int8)
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge[:-1]))
    chosen = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = start[np.append(first[1:], len(start)) - 1]
    first, chosen = start[first], chosen[first]
    row = np.searchsorted(at, first, "right") - 1
    return row, range_hash(prefix, chosen, chosen + GRAM), first, last, mix(range_hash(prefix, first, last + length) + (chosen - first).astype(np.uint64))


def pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """data and at as they are, or of one row over PIECE_BYTES its parts with where they begin; each string is in one."""
    if len(at) != 2 or len(data) <= PIECE_BYTES:
        yield data, at, 0
        return
    for first in range(0, len(data) - length + 1, PIECE_BYTES):
        part = data[first : first + PIECE_BYTES + length - 1]
        yield part, np.array([0, len(part)]), first


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the row and hash of each string of length bytes in the rows data[at[i]:at[i+1]]."""
    count = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    where = at[:-1][row] + start
    return row, start, range_hash(prefix_hash(data), where, where + length)


def runs(row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of the bytes that strings at sorted (row, start) cover, neighbours taken together."""
    if not len(row):
        return row, start, start
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)))
    last = np.append(first[1:], len(row)) - 1
    return row[first], start[first], start[last] + length


def repeated_spans(docs: DataFrame, stored: DataFrame, length: int) -> DataFrame:
    """(k, h, spans) of documents (k, h, text, ...), of which stored has the same by (k, h): the bytes [s, e) covered by strings that also start elsewhere.

    1. Each document's cover sample goes to the bucket of its substring; places whose whole context repeats inside a
       batch are settled there and only one of them is sent on.
    2. Buckets are sorted by context. Where a context repeats (a tie of up to 2 * length - GRAM bytes) all strings in it
       do; its rank settles this and no text is compared. Of each context one is left for the next step, if its
       substring has others.
    3. These contexts' bytes are fetched, and each bucket's strings are sorted by themselves, a bucket at a time.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, before = [], 0
            for block in blocks(batch, "text"):
                for data, at, offset in pieces(*utf8(block.column("text")), length):
                    row, *rest = cover(data, at, length)
                    parts.append((row + before, rest[0], rest[1] - at[row] + offset, rest[2] - at[row] + offset, rest[3]))
                before += block.num_rows
            if not parts:
                continue
            row, key, first, last, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, one, inverse, count = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
            done = count[inverse] > 1
            again = done.copy()
            again[one] = False
            names = [batch.column(c).to_numpy()[row] for c in ("k", "h")]
            key = np.where(again, mix(names[0].view(np.uint64) + mix(np.arange(len(key)))), key)  # settled: to any bucket
            columns = [key.view(np.int64), context.view(np.int64), *names, first, (last - first) * 2 + done]
            for a in range(0, len(key), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], ["key", "context", "k", "h", "s", "pack"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        large: int | None = None

        def decide(x: np.ndarray, whole: bool) -> pa.RecordBatch:
            nonlocal large
            key, context, k, h, s, pack = x
            new = np.append(True, key[1:] != key[:-1])
            newer = new | np.append(True, context[1:] != context[:-1])
            kind, one = np.cumsum(newer) - 1, np.flatnonzero(newer)
            done = (np.bincount(kind) > 1) | (np.bincount(kind, pack & 1) > 0)
            bucket = (np.cumsum(new) - 1)[one]
            many = np.bincount(bucket)[bucket]
            shards = np.maximum(1, -(-many // LARGE))
            ongoing = key[one] == large if large is not None else np.zeros(len(one), bool)
            if not whole:  # the last bucket goes on: it is a large one
                large = int(key[-1])
                ongoing |= key[one] == large
            shards = np.where(ongoing, STREAM_SHARDS, shards)
            ask = one[(many > 1) | ongoing]
            asked = np.concatenate([np.flatnonzero(done[kind]), ask])
            cover_ = np.arange(len(asked)) < len(asked) - len(ask)
            return pa.RecordBatch.from_arrays(
                [pa.array(cover_), *(pa.array(c[asked]) for c in (key, k, h, s, s + (pack >> 1))), pa.array(done[kind][asked]), pa.array(shards[kind][asked])],
                ["cover", "key", "k", "h", "s", "last", "done", "shards"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in ("key", "context", "k", "h", "s", "pack")]))
            x = np.concatenate(held, axis=1)
            keep = int(np.count_nonzero(x[0] == x[0, -1]))
            if keep < x.shape[1]:
                yield decide(x[:, : x.shape[1] - keep], True)
                held = [x[:, x.shape[1] - keep :]]
            elif keep > HELD_ROWS:
                tail = int(np.count_nonzero(x[1] == x[1, -1]))
                if tail < keep:
                    yield decide(x[:, : keep - tail], False)
                    held = [x[:, keep - tail :]]
                else:
                    held = [x]
            else:
                held = [x]
        if held:
            yield decide(held[0], True)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, "text")):
            data, at = utf8(batch.column("text"))
            asked = batch.column("asked")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            key, s, last, shards = (flat.field(c).to_numpy() for c in ("key", "s", "last", "shards"))
            done = flat.field("done").to_numpy(zero_copy_only=False)
            k, h = batch.column("k").to_numpy()[row], batch.column("h").to_numpy()[row]
            out: list[tuple] = []
            for i in range(len(row)):
                piece = data[at[row[i]] + s[i] : at[row[i]] + last[i] + length]
                if shards[i] == 1:
                    out.append((key[i], i, 0, piece.tobytes()))
                    continue
                _, start, hashes = window_hashes(piece, np.array([0, len(piece)]), length)
                part = mix(hashes) % np.uint64(shards[i])
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
                share = mix(key[i : i + 1].view(np.uint64) + part[order][cuts]).view(np.int64)
                hashes, start = hashes[order].astype("<u8"), start[order].astype("<u4")
                for name, a, b in zip(share.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
                    out.append((name, i, b - a, hashes[a:b].tobytes() + start[a:b].tobytes()))
            if out:
                keys, i, n, pieces = zip(*out, strict=True)
                i = np.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(k[i]), pa.array(h[i]), pa.array(s[i]), pa.array(done[i]), pa.array(n, pa.int64()), pa.array(pieces, pa.binary())], ["key", "k", "h", "s", "done", "packed", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sort(group: pa.Table) -> pa.RecordBatch:
            group = group.combine_chunks()
            packed = group.column("packed").to_numpy()
            data, at = utf8(group.column("data"))
            raw = np.flatnonzero(packed == 0)
            if len(raw) == len(packed):
                row, start, hashes = window_hashes(data, at, length)
            else:
                row, start, hashes = [], [], []
                for i in range(len(packed)):
                    piece = data[at[i] : at[i + 1]]
                    if packed[i]:
                        hashes.append(np.frombuffer(piece[: 8 * packed[i]].tobytes(), "<u8"))
                        start.append(np.frombuffer(piece[8 * packed[i] :].tobytes(), "<u4").astype(np.int64))
                    else:
                        _, b, c = window_hashes(piece, np.array([0, len(piece)]), length)
                        start.append(b)
                        hashes.append(c)
                    row.append(np.full(len(start[-1]), i))
                row, start, hashes = np.concatenate(row), np.concatenate(start), np.concatenate(hashes)
            order = np.argsort(hashes)
            x = hashes[order]
            same = np.append(False, x[1:] == x[:-1])
            same[:-1] |= same[1:]
            hit = np.zeros(len(x), bool)
            hit[order] = same
            done = group.column("done").to_numpy()
            hit &= ~done[row]
            s = group.column("s").to_numpy()
            at_row, a, b = runs(row[hit], start[hit], length)
            k, h = (group.column(c).to_numpy()[at_row] for c in ("k", "h"))
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(h), pa.array(a + s[at_row]), pa.array(b + s[at_row])], ["k", "h", "s", "e"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > SORT_BYTES:
                whole = pa.Table.from_batches(held)
                keys = whole.column("key").to_numpy()
                tail = int(np.count_nonzero(keys == keys[-1]))
                if tail < len(keys):
                    yield from cut_up(whole.slice(0, len(keys) - tail), sort)
                    rest = whole.slice(len(keys) - tail)
                    held, size = rest.to_batches(), rest.nbytes
        if held:
            yield from cut_up(pa.Table.from_batches(held), sort)

    sampled = docs.select("k", "h", "text").mapInArrow(sample, "key bigint, context bigint, k bigint, h bigint, s bigint, pack bigint")
    settled = sampled.repartition("key").sortWithinPartitions("key", "context").mapInArrow(settle, "cover boolean, key bigint, k bigint, h bigint, s bigint, last bigint, done boolean, shards bigint")
    asked = settled.where("not cover").groupBy("k", "h").agg(F.collect_list(F.struct("key", "s", "last", "done", "shards")).alias("asked"))
    # All of stored's columns are taken, so that this join and the caller's read one shuffle of the texts.
    fetched = stored.join(asked, ["k", "h"]).select("k", "h", "id", "text", "row", "asked").mapInArrow(contexts, "key bigint, k bigint, h bigint, s bigint, done boolean, packed bigint, data binary")
    compared = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "k bigint, h bigint, s bigint, e bigint")
    spans = settled.where("cover").select("k", "h", "s", (F.col("last") + length).alias("e")).union(compared)
    return spans.groupBy("k", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def cut_up(whole: pa.Table, sort) -> Iterator[pa.RecordBatch]:
    """Sort a run of whole buckets, about SORT_BYTES at a time."""
    keys = whole.column("key").to_numpy()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    step = max(1, int(len(first) * SORT_BYTES / max(whole.nbytes, 1)))
    ends = [*first[::step][1:].tolist(), len(keys)]
    start = 0
    for end in ends:
        yield sort(whole.slice(start, end - start))
        start = end


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """A row per input row: id, n_bytes, spans (removed byte runs, as array of s and e), kept (binary), and row, a
    struct of the input's other columns.

    A byte is removed if a string of length bytes that covers it also starts anywhere else, in another document or
    in the same one; matches never cross documents. Null texts are empty; texts under length bytes are kept whole;
    of repeated rows, as of exact copies, every byte that such a string covers goes. An empty table gives an empty
    result. With whole_characters, characters of which only some bytes would go go whole, so that kept stays valid
    UTF-8. A long text's strings are sampled PIECE_BYTES at a time. Rows with a null id are kept like others. docs should read the same rows in the same order each time, as files and
    checkpoints do: which of several copies in a batch stands for the others follows from their order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    keyed = docs.select(
        F.xxhash64(F.col(id_col)).alias("k"), F.coalesce(F.crc32(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")), F.lit(0)).alias("h"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row") if others else F.struct(F.lit(True).alias("only")).alias("row"),
    )
    stored = keyed
    spans = repeated_spans(keyed, stored, length)

    def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole, "text", 4 << 20)):
            data, at = utf8(batch.column("text"))
            lists = batch.column("spans")
            runs_out, kept = [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                found = lists[i].as_py() or []
                merged: list[dict] = []
                for x in found:
                    while whole_characters and x["s"] and text[x["s"]] & 0xC0 == 0x80:
                        x["s"] -= 1
                    while whole_characters and x["e"] < len(text) and text[x["e"]] & 0xC0 == 0x80:
                        x["e"] += 1
                    if merged and x["s"] <= merged[-1]["e"]:
                        merged[-1]["e"] = max(merged[-1]["e"], x["e"])
                    else:
                        merged.append(dict(x))
                left, pieces = 0, []
                for x in merged:
                    pieces.append(text[left : x["s"]].tobytes())
                    left = x["e"]
                kept.append(b"".join([*pieces, text[left:].tobytes()]))
                runs_out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at)), pa.array(runs_out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary()), batch.column("row")], [id_col, "n_bytes", "spans", "kept", "row"])

    joined = stored.join(spans, ["k", "h"], "left").select("id", "text", "spans", "row")
    return joined.mapInArrow(cut_bytes, f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary, row {keyed.schema['row'].dataType.simpleString()}")


def digest(removed: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
