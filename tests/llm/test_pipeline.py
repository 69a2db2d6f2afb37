from __future__ import annotations

import random

import corpus_pipeline
from clausework.llm import neardup, suffix, toxicity
from test_neardup import brute_classes


def table(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage = make(70)
    rows = []
    for k in range(160):
        text = make(r.randint(20, 90))
        if k % 4 == 0:
            text = f"you zonker {text} zonker"
        if k % 10 == 1:
            text = f"{text} {passage} {make(9)}"
        rows.append([k, text])
    rows += [[200, rows[2][1]], [201, rows[2][1] + " tail"], [202, None], [203, ""], [204, ""], [205, make(9000)], [None, make(40)], [206, "ab ab " * 400], [207, rows[3][1]], [207, rows[3][1]]]
    docs = [(i, t, "en", None if k % 5 == 0 else "hot" if k % 5 < 4 else "cold", len(t or ""), f"own {k}", k) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _class string, copy int"
    d = str(tmp_path)
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_and_run(spark, tmp_path):
    d = table(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, now = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        now = stage(spark, now, d)
        if k == len(corpus_pipeline.STAGES) - 1:
            break
        path = f"{d}/{name}.parquet"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == columns
        after = now.collect()
        if name == "toxicity":
            lex = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
            a = lex.automaton()
            assert sorted(r._class for r in after) == sorted(r._class for r in before if lex.score(a, r.text) < 0.5)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if "zonker" not in (r.text or "")}
        elif name == "near-dedup":
            with_id = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
            classes = brute_classes(with_id)
            assert {r.doc_id for r in after if r.doc_id is not None} == {i for i, c in classes.items() if i == c}
            assert len(after) == len(set(r.doc_id for r in after)) and None in {r.doc_id for r in after}
        elif name == "suffix-array":
            texts = [(r.text or "").encode() for r in before]
            seen: dict[bytes, int] = {}
            for t in texts:
                for p in range(len(t) - 199):
                    seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
            left = {}
            for r, t in zip(before, texts, strict=True):
                keep = bytearray(b"\1" * len(t))
                for p in range(len(t) - 199):
                    if seen[t[p : p + 200]] > 1:
                        keep[p : p + 200] = bytes(200)
                left[r._class] = bytes(x for x, y in zip(t, keep, strict=True) if y).decode(errors="replace")
            assert {r._class: r.text or "" for r in after} == left
        else:
            assert {r._class for r in after} <= {r._class for r in before} and 0.5 * len(before) < len(after) < 1.6 * len(before)
            by = {r._class: r for r in before}
            assert all(r == by[r._class] for r in after)
    out = now.collect()
    assert len(out) == len(before) and all(r.lossless and r.n_tokens == len(r.ids) for r in out)
    again = corpus_pipeline.run(spark, d)
    assert again.columns == now.columns and again.count() > 0


def test_empty_table(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
