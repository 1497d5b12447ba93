"""The pipeline against a brute-force version of its stages, on the small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sonoframe.llm import quality

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def features(t):
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_ends": sum(x.rstrip(" ")[-1] in quality.ENDS for x in lines), "n_lone": sum(x in quality.LONE for x in w), "n_shouts": t.count("!"), "n_upper": sum(c.isupper() for c in t), "n_lower": sum(c.islower() for c in t),
    }


def vote(f):
    known = {"greatest": max, "abs": abs, "ln": math.log} | f
    if not f["n_words"]:
        return (0,) * len(quality.RULES)
    return tuple(1 if (x := eval(m, known)) < good else -1 if x > bad else 0 for _, m, good, bad in quality.RULES)  # noqa: S307


def accepted(texts):
    f = {i: features(t) for i, t in texts.items()}
    ok = {i for i, x in f.items() if x["n_words"] >= 50 and 100 * x["n_repeat_words"] <= 50 * x["n_words"]}
    votes = {i: vote(f[i]) for i in ok}
    counts = Counter(votes.values())
    q = {v: 1 / (1 + math.exp(3 * v.count(-1) - v.count(1) / 2)) for v in counts}
    for step in range(26):
        good, bad = ({(j, k): (1 + sum(n * w[v] for v, n in counts.items() if v[j] == k)) / (3 + sum(n * w[v] for v, n in counts.items())) for j in range(len(quality.RULES)) for k in (-1, 0, 1)} for w in (q, {v: 1 - x for v, x in q.items()}))
        prior = (1 + sum(n * q[v] for v, n in counts.items())) / (2 + sum(counts.values()))
        q = {v: 1 / (1 + (1 - prior) / prior * math.prod(bad[j, k] / good[j, k] for j, k in enumerate(v))) for v in counts}
    return {i: texts[i] for i in ok if q[votes[i]] >= 0.5}


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def one_each(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    for _ in range(8):
        for i in texts:
            for j in texts:
                if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                    least[i] = min(least[i], least[j])
    return {i: t for i, t in texts.items() if least[i] == i}


def unrepeated(texts, n=200):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[k : k + n] for b in raw.values() for k in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        kept, at = [], 0
        for ch in texts[i]:
            size = len(ch.encode())
            if not gone[at : at + size].any():
                kept.append(ch)
            at += size
        out[i] = "".join(kept)
    return out


def clean(texts, items):
    def cut(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    asked = [s for t in items if (s := cut(t))]
    own = {i: cut(t) for i, t in texts.items()}
    return {i: t for i, t in texts.items() if not any(len(s & own[i]) >= 0.8 * len(s) for s in asked)}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def test_pipeline_is_brute_force(spark, texts):
    kept = one_each(accepted(texts))
    left = clean(unrepeated(kept), [r[0] for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == set(left)
    for p in pieces:
        ids = np.array([*tok.encode(left[p.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(len(tok.encode(t).ids) + 1 for t in left.values())


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(None, "x", "en", "s", 1), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "word " * 5, "en", "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            assert out.count() <= 4
            if name != "packing":
                assert out.columns == docs.columns
