from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from clausework.llm import suffix as S


def brute_bytes(texts: list[bytes], w: int = 200):
    c = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - w + 1):
            if c[t[i : i + w]] > 1:
                gone[i : i + w] = 1
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_array_and_search_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        al = r.choice([b"ab", b"a", b"abcdef", b"\x00a"])
        base = bytes(r.choice(al) for _ in range(r.randint(1, 60)))
        segs = [bytes(r.choice(al) for _ in range(r.randint(1, 40))) + (base if r.random() < 0.5 else b"") for _ in range(r.randint(1, 8))]
        w = r.randint(1, 25)
        c = Counter(s[i : i + w] for s in segs for i in range(len(s) - w + 1))
        want = [i + w <= len(s) and c[s[i : i + w]] > 1 for s in segs for i in range(len(s))]
        assert (S.repeated_windows(segs, w) == np.array(want)).all()
        q = [bytes(r.choice(al) for _ in range(r.randint(1, 40))) + base for _ in range(3)]
        have = {s[i : i + w] for s in segs for i in range(len(s) - w + 1)}
        assert (S.search_windows(segs, q, w) == np.array([i + w <= len(s) and s[i : i + w] in have for s in q for i in range(len(s))])).all()


def check(spark, texts, **extra):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.removed_bytes(df).collect()}
    want = brute_bytes([(t or "").encode() for t in texts])
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k] == w, (k, got[k], w)


def texts_with_repeats(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéfghij") for _ in range(r.randint(1, 8)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, other = make(70), make(45)
    out = [make(r.randint(0, 200)) for _ in range(12)]
    out += [make(40) + " " + passage + " " + make(30) for _ in range(6)] + [out[3]] * 3 + [None, "", "x" * 199, "x" * 200, "y" * 450, "Tior, " * 100, "Tior, " * 70, "ab " * 30]
    out += [make(20) + other + make(3) + other, passage[:150], out[5][:len(out[5]) // 2] + make(10) + out[5][len(out[5]) // 2:]]
    return out


def test_bytes_against_brute_force(spark):
    check(spark, texts_with_repeats())


def test_crowded_anchors_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENTS", 3)
    check(spark, texts_with_repeats(4))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    check(spark, texts_with_repeats(5))


def test_driver_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], brute_bytes([r.text.encode() for r in rows]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op1(spark, sf).collect()}
    assert got == want


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _h1 int")
    assert S.removed_bytes(df).count() == 0
    t = "é" * 150
    df = spark.createDataFrame([(1, t + "a" * 7, 5, 3), (2, t + "b", 6, 3), (3, None, 7, 0)], "doc_id long, text string, n_chars long, _x int")
    got = {r.doc_id: r for r in S.deduplicated(df).collect()}
    assert got[1].text == "a" * 7 and got[2].text == "b" and got[3].text is None and got[1].n_chars == 7 and got[1]._x == 3
