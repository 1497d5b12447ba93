"""Nulls, empty tables and texts, ties, repeated rows and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonoframe.llm import chat_format, decontaminate, lm_scoring, ngram_join, packing, quality, suffix_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, score string, kept string, rule string, n_tokens string, spans string, key string"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PROSE = " ".join(f"word{i % 37}x{i}" for i in range(120)) + ".\nAnd so it goes on, line by line."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], SCHEMA)


CASES = {
    "empty": [],
    "null text": [(1, None), (2, "one two three four five six")],
    "null id": [(None, "one two three four five six"), (2, "a b")],
    "empty text": [(1, ""), (2, " \n\t ")],
    "repeated": [(1, PROSE), (1, PROSE), (2, PROSE)],
    "long": [(1, "abc " * 60_000), (2, "x" * 150_000)],
}
OPERATORS = {
    "lm": lambda d: lm_scoring.stupid_backoff(d),
    "decontaminate": lambda d: decontaminate.contained(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "suffix": lambda d: suffix_dedup.remove_repeats(d),
    "pack": lambda d: packing.pack(d, BYTES, public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "quality": lambda d: quality.judge(d),
    "toxicity": lambda d: toxicity.score(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))),
    "near": lambda d: ngram_join.near_duplicates(d),
    "tokens": lambda d: token_counts.token_counts(d, PIECES),
    "urls": lambda d: url_filter.judge(d, id_col="doc_id", url_col="text"),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", OPERATORS)
def test_runs_on_odd_tables(spark, name, case):
    rows = OPERATORS[name](docs(spark, CASES[case])).collect()
    if name not in ("pack", "decontaminate"):
        assert len(rows) == len(CASES[case])
    if case == "empty":
        assert rows == []


def test_lm_scores_without_words_are_null(spark):
    rows = {r.doc_id: r for r in lm_scoring.stupid_backoff(docs(spark, [(1, None), (2, "a b a"), (3, "a b c")])).collect()}
    assert rows[1].n_words == 0 and rows[1].score is None
    # a, b and (a, b) are in the other; of doc 2's own words a third is new to the context b
    third = np.log(1 / 3)
    assert rows[2].n_order_2 == 1 and rows[2].n_order_1 == 2 and rows[2].n_order_3 == 0
    assert rows[2].score == pytest.approx(third + np.log(1 / 1) + np.log(0.4**2 * 1 / 3))


def test_lm_scores_do_not_depend_on_blocks_and_levels(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) if x < 400)) for i in range(120)]
    found = lambda: {r.doc_id: tuple(r) for r in lm_scoring.stupid_backoff(docs(spark, rows)).collect()}
    one = found()
    monkeypatch.setattr(lm_scoring, "BLOCK", 800)  # some 30 blocks, three levels of four
    monkeypatch.setattr(lm_scoring, "FAN_BITS", 2)
    many = found()
    assert {i: r[:-2] for i, r in one.items()} == {i: r[:-2] for i, r in many.items()}
    assert all(one[i][-1] == pytest.approx(many[i][-1]) for i in one)


def test_decontaminate_ignores_short_items_and_finds_long(spark):
    items = spark.createDataFrame([(1, "too short an item"), (2, " ".join(f"w{i}" for i in range(40))), (3, None)], "item_id bigint, text string")
    long = " ".join(f"f{i}" for i in range(5000))
    d = docs(spark, [(1, f"{long} {' '.join(f'w{i}' for i in range(36))} {long}"), (2, long), (3, "too short an item"), (4, " ".join(f"w{i}" for i in range(30)))])
    found = decontaminate.contained(d, items).collect()
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found] == [(1, 2, 32, 36)]


def test_decontaminate_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 100)
    texts = [(i, " ".join(f"w{i}y{j}" for j in range(12))) for i in range(9)]
    items = spark.createDataFrame(texts, "item_id bigint, text string")
    found = decontaminate.contained(docs(spark, texts), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(9)]


def brute_spans(texts, length):
    seen = {}
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("large,held", [(4096, 200_000), (2, 200_000), (4096, 5)])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, large, held):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", held)
    rng = np.random.default_rng(5)
    shared = [bytes(rng.integers(97, 101, n).astype(np.uint8)).decode() for n in (199, 200, 201, 260, 900)]
    texts = ["".join(x for _ in range(3) for x in (bytes(rng.integers(97, 123, int(rng.integers(0, 400))).astype(np.uint8)).decode(), shared[int(rng.integers(5))])) for _ in range(40)]
    texts += ["é" * 300, "é" * 301, "a" * 199, "a" * 450, "", "ab" * 200, shared[4]]
    out = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts)))).collect()}
    want = brute_spans([t.encode() for t in texts], 200)
    assert [out[i] for i in range(len(texts))] == want


def test_packing_round_trip(spark):
    tok = Tokenizer.from_file(BYTES)
    rows = [(i, PROSE * n + ("<|endoftext|>" if i % 3 == 0 else "")) for i, n in enumerate([0, 1, 2, 3, 5, 8, 13, 1, 1, 2])] + [(99, None)]
    pieces = packing.pack(docs(spark, rows), BYTES, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    sequences = {}
    for i, text in rows:
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p.doc_tokens == len(ids) for p in own)
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_equal_rows_are_dealt_and_counted(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)  # some 30 blocks
    rows = [(1, PROSE)] * 600 + [(2, "nothing like the others"), (None, PROSE)]
    d = docs(spark, rows).repartition(3)
    scored = lm_scoring.stupid_backoff(d)
    out = scored.collect()
    n = len(PROSE.split())
    assert len(out) == 602 and {(r.n_words, r.n_order_3) for r in out if r.doc_id != 2} == {(n, n - 2)}
    assert len({round(r.score, 9) for r in out if r.doc_id == 1}) == 1
    left = {r.doc_id: (bytes(r.kept), r.n_bytes) for r in suffix_dedup.remove_repeats(d).collect()}
    assert left[1][0] == left[None][0] == b"" and left[2][0] == b"nothing like the others"
    assert suffix_dedup.remove_repeats(d).count() == 602


def test_packing_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    d = spark.range(0, 2000, 1, 3).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(PROSE).alias("text"))
    n = len(Tokenizer.from_file(BYTES).encode(PROSE).ids) + 1
    pieces = packing.pack(d, BYTES, public_tokenizers.path("byte_bpe_50k.tiktoken")).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("shard")).agg(F.sum("length").alias("n")).collect()
    assert sum(p.n for p in pieces) == 2000 * n
    assert len(pieces) == 40 and max(p.n for p in pieces) < 100 * n


def test_packing_balances_cost():
    lengths = np.array([1500] * 8 + [250] * 20 + [96] * 8)
    pieces = packing.assign(lengths, 2048)
    assert sum(n for _, _, n, _ in pieces) == lengths.sum()
    longest = {s for i, _, n, s in pieces if n == 1500}
    assert len(longest) == 8


def test_quality_features_and_votes(spark):
    junk = " ".join(f"a{i}%%%" for i in range(200))
    rows = [(i, PROSE.replace("x", f"q{i}")) for i in range(60)] + [(100 + i, junk.replace("a", f"b{i}")) for i in range(8)] + [(200, None), (201, "a b c " * 40)]
    out = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert all(out[i].kept for i in range(60)) and not any(out[100 + i].kept for i in range(8))
    assert out[200].base_failed and not out[200].kept and out[200].n_words == 0
    assert out[201].n_repeat_words == 120 and out[201].base_failed


def test_repeat_words_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), int(rng.integers(0, 30)))) for _ in range(80)] + ["a a a", "a a a a", "a\x0bb\x0cc d", "x\n\nx\n \nx"]

    def brute(t):
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})

    out = {r.doc_id: r for r in quality.features(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (out[i].n_words, out[i].n_repeat_words) == (len(t.split()), brute(t)), t
    assert out[len(texts) - 1].n_dup_lines == 2


def test_url_parts_and_rules(spark):
    urls = {
        "http://Example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.EXAMPLE.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/x#y": ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, None),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://badcom/": ("badcom", "/", None, None),
        "http://é.com/ü?a/b": ("é.com", "/ü", "com/", "allow"),
        "no scheme": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(99, None)], "page_id bigint, url string")
    out = {r.page_id: r for r in url_filter.judge(d).collect()}
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert verdict in (None, out[i].verdict)
    assert (out[99].host, out[99].path, out[99].rule) == ("", "", None)


def test_url_model_learns(spark):
    good = [f"http://good{i}.com/news/{i}" for i in range(60)]
    bad = [f"http://spam{i}.net/es/win-{i}" for i in range(60)]
    ask = ["http://goodx.org/news/5", "http://spamx.org/es/win-7"]
    d = spark.createDataFrame(list(enumerate(good + bad + ask)), "page_id bigint, url string")
    out = {r.page_id: r.verdict for r in url_filter.judge(d).collect()}
    assert [out[120], out[121]] == ["allow", "block"]


def test_chat_round_trip_and_trees(spark):
    odd = "\\### Assistant: </turn> ok \\l \\\\g <turn:x>\n"
    d = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", None), (2, 0, None, ""), (3, 5, "<a>\\", "é😀")], "conv_id bigint, turn bigint, role string, text string")
    made = chat_format.format_paths(chat_format.linear(d))
    out = {r.conv_id: r for r in chat_format.digest(made).collect()}
    said = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert out[1].turns_sha256 == said(("user", odd), ("assistant", ""), ("assistant", odd)) and out[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert out[2].turns_sha256 == said(("", "")) and out[2].loss_chars == 0
    assert out[3].turns_sha256 == said(("<a>\\", "é😀"))
    assert chat_format.format_paths(chat_format.linear(d.limit(0))).count() == 0
    tree = [(1, 1, None, 0.0, "user", "root"), (1, 2, 1, 0.1, "assistant", "worse"), (1, 3, 1, 0.9, "assistant", "better"), (1, 4, 3, 0.8, "user", "leaf"), (1, 5, 3, 0.2, "user", "low"), (2, 7, 6, 0.0, "user", "orphan"), (3, 1, 2, 1.0, "user", "loop"), (3, 2, 1, 1.0, "user", "loop")]
    nodes = spark.createDataFrame(tree, "conv_id bigint, node bigint, parent bigint, score double, role string, text string")
    path = sorted((r.conv_id, r.depth, r.node) for r in chat_format.tree_paths(nodes).collect())
    assert path == [(1, 0, 1), (1, 1, 3), (1, 2, 4), (2, 0, 7)]


def test_chat_all_paths_and_roots(spark):
    tree = [(1, 1, None, 0.0, "user", "a"), (1, 2, 1, 0.1, "assistant", "b"), (1, 3, 1, 0.9, "assistant", "c"), (1, 7, 6, 0.5, "user", "other root"), (1, 8, 7, 0.5, "assistant", "d")]
    nodes = spark.createDataFrame(tree, "conv_id bigint, node bigint, parent bigint, score double, role string, text string")
    turns = lambda n: sorted((r.path, r.depth, r.node) for r in chat_format.tree_paths(nodes, n).collect())
    assert turns(1) == [(3, 0, 1), (3, 1, 3), (8, 0, 7), (8, 1, 8)]
    assert turns(None) == [(2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 3), (8, 0, 7), (8, 1, 8)]
    assert chat_format.digest(chat_format.format_paths(nodes, paths=None)).count() == 3


def test_chat_null_conversation(spark):
    d = spark.createDataFrame([(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat_format.digest(chat_format.format_paths(chat_format.linear(d))).collect()}
    assert {i: r.n_turns for i, r in out.items()} == {None: 2, 1: 1}
    assert out[None].loss_sha256 == hashlib.sha256(b"a").hexdigest()


def test_chat_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string")
    nodes = chat_format.linear(d)
    for c in ("path", "depth", "rank", "span", "formatted", "spans", "loss", "up", "root", "has"):
        nodes = nodes.withColumn(c, F.lit("x"))
    plain, clashing = chat_format.format_paths(chat_format.linear(d)).collect(), chat_format.format_paths(nodes).collect()
    assert plain == clashing and len(plain) == 1


def test_chat_long_chain(spark):
    d = spark.range(300).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = chat_format.digest(chat_format.format_paths(chat_format.linear(d))).first()
    assert out.n_turns == 300
    assert out.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", (2, 4))
    monkeypatch.setattr(ngram_join, "PRUNE_BLOCK", (2, 4))
    monkeypatch.setattr(ngram_join, "FEW", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 400)
    rng = np.random.default_rng(8)
    base = [[f"w{i}_{j}" for j in range(int(rng.integers(30, 120)))] for i in range(12)]
    texts = []
    for i, words in enumerate(base):
        for k in range(i):
            own = list(words)
            for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
                own[at] = f"changed{i}_{k}_{at}"
            texts.append(" ".join(own))
    texts += ["short one", "short one", "other short", "", None, " ".join(base[3]), " ".join(base[3])]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    n = len(texts)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    parent = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    parent[i] = min(parent[i], parent[j])
    out = {r.doc_id: r for r in ngram_join.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    for i in range(n):
        assert (out[i].n_links, out[i].class_id) == (sum(link[i]), parent[i]), (i, texts[i])


def test_bayesian_limits():
    least = ngram_join.least_matches(0.8, 1e-5, 160, 16)
    assert sorted(least) == list(range(16, 161, 16)) and all(least[n] < 0.8 * n for n in least)
    assert least[160] > 0.6 * 160


def test_token_counts_splice(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["a", "ab", " ", "  ", "\n", "é", "😀", "▁", "word", "."], int(rng.integers(1, 900)))) for _ in range(60)]
    texts += ["x" * 1000, "a  " * 300, "é" * 500 + " b", " " * 700, "", "<s> </s>"]
    counter = token_counts.ChunkedCounter(PIECES, chunk=61, overlap=4)
    assert counter.splits
    assert counter.many(texts) == [len(x) for x in model.encode(texts)]
    out = {r.doc_id: r for r in token_counts.token_counts(docs(spark, [*enumerate(texts), (999, None)]), PIECES, limit=100).collect()}
    assert [(out[i].n_tokens, out[i].n_bytes) for i in range(len(texts))] == [(len(model.encode(t)), len(t.encode())) for t in texts]
    assert out[999].n_tokens == 0 and not out[999].over_limit


def test_token_counts_without_spaces():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(12)
    parts = ["a", "ab", "xyz", "é", "漢", "字", "the", "ing", "ไทย", "😀", "0", "\n"]
    texts = ["".join(rng.choice([parts[i] for i in rng.integers(0, len(parts), int(rng.integers(1, 5)))], int(rng.integers(1, 500)))) for _ in range(300)]
    counter = token_counts.ChunkedCounter(PIECES, chunk=47, overlap=3)
    assert counter.many(texts) == [len(x) for x in model.encode(texts)]
    counter, sizes = token_counts.ChunkedCounter(PIECES, chunk=4096, overlap=64), []
    encode = counter._encode
    counter._encode = lambda t, a, b: (sizes.append(b - a), encode(t, a, b))[1]
    for text in ("".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 60_000)), "xyz" * 20_000, "a" * 60_000):
        assert counter.many([text]) == [len(model.encode(text))]
    assert max(sizes) <= 4096 + 64 and sum(sizes) < 1.1 * 180_000


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(4)
    weights = rng.random((500, 40)) * (rng.random((500, 40)) < 0.1)
    norm = np.linalg.norm(weights, axis=1, keepdims=True)
    weights = np.divide(weights, norm, out=weights, where=norm > 0)
    index = toxicity.BlockMaxIndex(list(range(500)), (rng.random(500) < 0.3).astype(float), weights, np.ones(500))
    for _ in range(50):
        query = rng.random(40) * (rng.random(40) < 0.2)
        terms = np.flatnonzero(query)
        if not len(terms):
            continue
        _, near, _ = index.nearest(terms, query[terms], 10)
        every = np.sort((weights @ query)[(weights @ query) > 0])[::-1][:10]
        assert near == pytest.approx(every)


def test_toxicity_separates(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.integers(0, 500)}" for _ in range(60)]
        if i % 4 == 0:
            words[5:9] = ["Idiot,", "scum", "moron!", "trash"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    known = spark.createDataFrame(labels[:200], "doc_id bigint, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), known).collect()}
    assert all((out[i] >= 0.5) == bool(labels[i][1]) for i in range(200, 300))
    assert all(0 <= s <= 1 for s in out.values())


def test_toxicity_neighbours_are_of_all_words(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 900, 40)) for _ in range(120)]
    for i in (3, 50, 77):  # a word of three examples of one class, too few to tell it from chance
        texts[i] += " zorgle"
    texts += ["zorgle and what nobody else says", texts[9] + " more"]
    labels = spark.createDataFrame([(i, int(i in (3, 50, 77) or i % 6 == 0)) for i in range(120)], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs(spark, list(enumerate(texts))), labels).collect()}
    assert sorted(out[120].evidence) == [3, 50, 77] and out[120].score >= 0.5
    known = {w for t in texts[:120] for w in t.split()}
    idf = {w: np.log((1 + len(texts)) / (1 + sum(w in t.split() for t in texts))) + 1 for w in known}
    vector = lambda t: {w: (1 + np.log(t.split().count(w))) * idf[w] for w in set(t.split()) & known}
    every = [vector(t) for t in texts]
    for i, v in enumerate(every):
        near = sorted(((-sum(v.get(w, 0) * x for w, x in e.items()) / np.linalg.norm(list(e.values())), j) for j, e in enumerate(every[:120]) if j != i))
        assert set(out[i].evidence) == {j for s, j in near[:5] if s < 0}


def toxic_table(seed, n=160):
    """Texts with odd words, near copies, repeated texts and labels that mostly follow four words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"W{rng.integers(0, 300)}" for _ in range(int(rng.integers(3, 40)))]
        if i % 5 == 0:
            words[1:2] = list(rng.choice(["Idiot,", "scum", "moron!", "“trash”"], 2))
        rows.append(" ".join(words))
    rows += [rows[5], rows[7] + " more", "", None, "...", rows[10].upper()]
    labels = [(i, int(i % 5 == 0) if i != 35 else 0) for i in range(n) if i % 3]
    return list(enumerate(rows)), labels


def brute_toxicity(rows, labels, k):
    """score of every row, by the definitions alone: no index, no arrays of terms."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[“”«»…]", " ", (t or "").lower()))
    texts = dict(rows)
    known = {}
    for i, label in labels:
        known.setdefault(texts[i] or "", []).append(label)
    bags = {t: Counter(words(t)) for t in known}
    label = {t: max(v) for t, v in known.items()}
    count = {c: sum(len(known[t]) for t in known if label[t] == c) for c in (0, 1)}
    share = {t: count[label[t]] / sum(x == label[t] for x in label.values()) for t in known}
    mean = sum(share.values()) / len(share)
    share = {t: x / mean for t, x in share.items()}
    every = [set(words(t)) for _, t in rows]
    vocabulary = {w for b in bags.values() for w in b}
    idf = {w: math.log((1 + len(rows)) / (1 + sum(w in x for x in every))) + 1 for w in vocabulary}
    vector = lambda b: {w: (1 + math.log(n)) * idf[w] for w, n in b.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    unit = lambda v: {w: x / norm(v) for w, x in v.items()}
    least = lambda t: min((tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)), key=lambda g: shingle(g), default=("whole", *words(t)))

    def shingle(g):
        return int(toxicity.shingle_hashes(toxicity.words(pa.array([" ".join(g)]))[0], np.array([0, 5]), 5)[0][0])

    group = {t: (least(t), label[t]) for t in known}
    groups = set(group.values())
    n1, n0 = (max(sum(g[1] == c for g in groups), 1) for c in (1, 0))
    telling = {}
    for w in vocabulary:
        held = {group[t] for t in bags if w in bags[t]}
        a, n = sum(g[1] for g in held), len(held)
        telling[w] = 1 + (a / n1 - (n - a) / n0) ** 2 / (n / (n0 + n1) * (1 / n0 + 1 / n1))
    prior = sum(share[t] * label[t] for t in known) / sum(share.values())
    blank = [t for t in known if not bags[t]]
    none = (sum(share[t] * label[t] for t in blank) + prior) / (sum(share[t] for t in blank) + 1)
    vectors = {t: unit(vector(b)) for t, b in bags.items()}

    def vote(t):
        q = unit(vector(Counter(words(t))))
        near = sorted(((sum(q.get(w, 0) * x for w, x in v.items()), e) for e, v in vectors.items() if e != (t or "")), key=lambda x: -x[0])[:k]
        near = [x for x in near if x[0] > 1e-9]
        if not near:
            return none
        told = {w: x * telling[w] for w, x in q.items()}
        up, total = prior / 1.05, 1 / 1.05
        for _, e in near:
            v = {w: x * telling[w] for w, x in vectors[e].items()}
            c = min(sum(told.get(w, 0) * x for w, x in v.items()) / norm(told) / norm(v), 1)
            up, total = up + share[e] * c / (1.05 - c) * label[e], total + share[e] * c / (1.05 - c)
        return up / total

    order = list(known)
    slope, offset = toxicity.platt(np.array([vote(t) for t in order]), np.array([label[t] for t in order], float), np.array([share[t] for t in order]))
    return {i: 1 / (1 + math.exp(-(slope * toxicity.logit(vote(t)) + offset))) for i, t in rows}


def test_toxicity_is_brute_force_and_blind_to_ids(spark):
    rows, labels = toxic_table(3)
    score = lambda r, y: {x.doc_id: x.score for x in toxicity.score(docs(spark, r), spark.createDataFrame(y, "doc_id bigint, toxic int"), neighbours=200).collect()}
    out = score(rows, labels)
    assert out == pytest.approx(brute_toxicity(rows, labels, 200), abs=1e-6)
    swapped = {i: 7919 * (i + 3) % 100_003 for i, _ in rows}
    again = score([(swapped[i], t) for i, t in rows], [(swapped[i], y) for i, y in labels])
    assert {i: again[swapped[i]] for i in out} == out


def test_toxicity_leaves_its_own_label_out(spark):
    rows, labels = toxic_table(9)
    score = lambda y: {x.doc_id: x.score for x in toxicity.score(docs(spark, rows), spark.createDataFrame(y, "doc_id bigint, toxic int")).collect()}
    one = next(i for i, y in labels if y)
    plain, flipped = score(labels), score([(i, 1 - y if i == one else y) for i, y in labels])
    moved = sorted(abs(plain[i] - flipped[i]) for i in plain)
    assert (plain[one] >= 0.5) == (flipped[one] >= 0.5) and abs(plain[one] - flipped[one]) <= moved[-1]


def test_platt_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    chance = rng.random(4000)
    labels = (rng.random(4000) < chance).astype(float)
    slope, offset = toxicity.platt(1 / (1 + np.exp(-3 * toxicity.logit(chance) - 1)), labels, np.ones(4000))
    assert slope == pytest.approx(1 / 3, abs=0.03) and offset == pytest.approx(-1 / 3, abs=0.1)
    assert toxicity.platt(np.array([0.2]), np.array([1.0]), np.ones(1)) == (1.0, 0.0)


def test_crc_of_pieces_is_of_32_bit_ids(spark):
    out = packing.pack_digest(docs(spark, [(1, "hello world")])).collect()
    ids = [*Tokenizer.from_file(BYTES).encode("hello world").ids, 1]
    want = np.array(ids, "<u4")
    at = {p.start: p for p in out}
    for start, p in at.items():
        assert p.ids_crc32 == zlib.crc32(want[start : start + p.length].tobytes())
