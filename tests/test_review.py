"""Review operators against brute force and on the cases that the driver's tables do not hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clausework.operators import knowledge as K
from clausework.operators import review as R

TAGGED = "record_id long, nl string, phenomena array<string>"


def brute(rows, n, place):
    once = {}
    for i, nl, tags in sorted(rows):
        once.setdefault(" ".join(nl.lower().split()), (i, tags))
    pool = sorted(once.values(), key=lambda r: place[r[0]])
    taken = {}
    while len(taken) < min(n, len(pool)):
        before = len(taken)
        for tag in R.TAGS:
            row = next((i for i, tags in pool if i not in taken and tag in tags), None)
            if row is not None and len(taken) < n:
                taken[row] = tag
        if len(taken) == before:
            break
    return [(i, t, k) for k, (i, t) in enumerate(taken.items())]


@pytest.mark.parametrize(("seed", "n"), [(1, 0), (2, 7), (3, 40), (4, 1000), (5, -3)])
def test_stratified_selection(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, f"Text {rng.randrange(150)}", rng.sample(R.TAGS, rng.randrange(1, 4))) for i in range(200)] + [(200, "lonely", []), (201, "odd", ["unknown tag"])]
    df = spark.createDataFrame(rows, TAGGED)
    place = {r[0]: (r[1], r[0]) for r in df.select("record_id", F.xxhash64("record_id")).collect()}
    got = sorted((r.record_id, r.picked_as, r.pick) for r in R.stratified(df, n).collect())
    assert got == sorted(brute(rows, n, place))


def test_stratified_excludes_by_key_and_takes_an_empty_table(spark):
    df = spark.createDataFrame([(1, "Not  A", ["negation"]), (2, "b", ["other"]), (3, None, ["other"])], TAGGED)
    out = spark.createDataFrame([("not a",)], "nl string")
    assert {r.record_id for r in R.stratified(df, 9, excluded=out).collect()} == {2, 3}
    assert R.stratified(df.limit(0), 9).count() == 0


def test_annotations_of_an_unknown_and_a_repeated_id(spark):
    names = "record_id string, nl string, status string, reviewed_by string, reviewer_type string, formalizable string, cnl string, pattern string, review_seconds string, compiled string"
    good = ("a", "x", "reviewed", "me", None, "false", None, None, "inf", None)
    rows = spark.createDataFrame([good, ("b", "x", "draft", None, None, None, None, None, None, None), ("b", "y", "draft", None, None, None, None, None, None, None), ("z", None, "reviewed", "me", "human", "true", "c", "odd", "", "k")], names)
    known = spark.createDataFrame([("a", "x"), ("b", "x")], "record_id string, nl string")
    got = {(r.record_id, r.rule) for r in R.annotation_violations(rows, known).collect()}
    assert got == {("a", "duration"), ("b", "repeated id"), ("z", "unknown id"), ("z", "positive without form")}
    assert R.reviewed_export(rows, known).count() == 0


def test_frozen_inputs(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "record_id int, kif string")
    assert R.frozen_violations(rows, sha256="a", expected_sha256="b", expected_count=3) == ["sources changed", "count changed", "repeated ids", "labels"]
    assert R.frozen_violations(rows.drop("kif").distinct(), sha256="a", expected_sha256="a", expected_count=1) == []


def test_restating_and_proofs(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "(subclass A B)\n(subclass A B)"), (4, "(and (subclass A B) (subclass B A))")], "record_id int, kif string")
    known = spark.createDataFrame([("A", "B"), ("A", "B")], "child string, parent string")
    assert {r.record_id: r.restates for r in R.restates(rows, known).collect()} == {1: False, 2: False, 3: True, 4: False}
    facts = [("f1", "subclass", "A", "B", False), ("f0", "subclass", "A", "B", False), ("f2", "subclass", "B", "C", False), ("f3", "subclass", "C", "A", False), ("f4", "instance", "i", "C", False), ("f5", "instance", "i", "A", False), ("f6", "instance", "i", "D", True)]
    asked = [(1, "subclass", "A", "C"), (2, "instance", "i", "A"), (3, "instance", "i", "B"), (4, "instance", "i", "D"), (5, "subclass", "X", "A")]
    got = K.proofs(spark.createDataFrame(facts, "record_id string, relation string, left string, right string, negative boolean"), spark.createDataFrame(asked, "id int, relation string, left string, right string"))
    assert {r.id: r.records for r in got.collect()} == {1: ["f0", "f2"], 2: ["f5"], 3: ["f0", "f5"]}
    assert K.bundle_status(spark.createDataFrame([], "record_id string, kif string")).collect()[0].status == "satisfiable"


def test_counts_of_nothing(spark):
    empty = spark.createDataFrame([], "bucket string, formalizable boolean")
    assert {r.n for r in R.with_zeros(empty, "bucket", R.BUCKETS).collect()} == {0}
    assert R.diagnosis(empty).collect()[0].accuracy is None


def test_declarations_match_whole_words(spark):
    registry = spark.createDataFrame([("tug boat", "is a", "Tug"), ("tug", "is a", "Small"), ("a.b", "is a", "Dot")], "alias string, evidence_cue string, symbol string")
    rows = spark.createDataFrame([(1, "The  Tug boats", "it is a b"), (2, "Tug boat", "is a"), (3, "axb", "is a"), (4, "A a.b c", "IS A"), (5, None, "is a"), (6, "tug", None)], "id int, text string, evidence string")
    assert {r.id: (r.n_matches, r.symbol) for r in R.declaration_matches(rows, registry).collect()} == {1: (1, "Small"), 2: (2, None), 3: (0, None), 4: (1, "Dot"), 5: (0, None), 6: (0, None)}
    assert R.declaration_matches(rows, registry.limit(0)).where("n_matches > 0").count() == 0


def test_stratified_null_texts_and_tags(spark):
    df = spark.createDataFrame([(k, None if k == 7 else f"Text  {k % 5}", None if k == 3 else ["other"]) for k in range(20)], TAGGED)
    out = spark.createDataFrame([("text 0",), (None,)], "nl string")
    assert sorted(r.record_id for r in R.stratified(df, 60, excluded=out).collect()) == [1, 2, 4, 7]
