from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clausework.functions import cnl as C
from clausework.operators import knowledge as K
from clausework.operators import pairs as P
from clausework.operators import segment as S
from clausework.plans import catalog
from clausework.sources import kif as KIF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sf, duck, name):
    got = catalog.Q[name](spark, sf)
    cols = sorted(got.columns)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in cols)) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == want


def test_generated_pairs_compile(spark, sf):
    rows = catalog.Q["gen_compiled"](spark, sf).collect()
    assert {r.pattern for r in rows} == {"binary", "conditional", "subclass", "nary", "negation"} and all(r.n == r.n_same for r in rows)


def test_parser_refuses():
    for bad in ("", "Ferry", "not every ?x is-a Ferry", "if ?x is-a Ferry then", "between [ Port ]", "some Ferry is-a Port", "Ferry # Port"):
        with pytest.raises(C.ParseError):
            C.parse(bad)
    assert C.parse("Ferry subclass-of Vessel // a note").kif == "(subclass Ferry Vessel)"


def test_blocks_sections_and_resets(spark):
    df = spark.createDataFrame([(1, "Opening Words\nfirst line here.\n\nsecond block.\nNext Part\nthird."), (2, "no section here.")], "doc_id int, text string")
    got = [(r.doc_id, r.line, r.section) for r in S.blocks(df).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, "first line here.", "Opening Words"), (1, "second block.", "Opening Words"), (1, "third.", "Next Part"), (2, "no section here.", None)]


def test_closure_equals_brute_force(spark):
    r = random.Random(4)
    e = {(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(14)}
    want = set(e)
    while True:
        more = {(a, d) for a, b in want for c, d in e if b == c} - want
        if not more:
            break
        want |= more
    got = K.closure(spark.createDataFrame(sorted(e), "a string, b string")).collect()
    assert {(x.a, x.b) for x in got} == want
    assert all(x.path[0] == x.a and x.path[-1] == x.b and len(x.path) == x.hops + 1 and all((p, q) in e for p, q in zip(x.path[:-1], x.path[1:], strict=True)) for x in got)


def test_inconsistent_theory(spark):
    lit = lambda rows: spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id int, kif string").select("id", *[c.alias(n) for n, c in C.ground_literal(F.col("kif")).items()])
    got = K.answers(lit(["(subclass A B)", "(subclass B D)", "(not (subclass A D))"]).drop("id"), lit(["(subclass A B)", "(subclass Z B)"]))
    assert {r.id: r.status for r in got.collect()} == {0: "inconsistent", 1: "unknown"}


def test_response_parts(spark):
    df = spark.createDataFrame([("One fact.\nAmbiguous: which one\n",), ("  ",)], "r string")
    got = df.select(*[c.alias(k) for k, c in S.parse_response(F.col("r")).items()]).collect()
    assert got[0].normalized == ["One fact."] and got[0].ambiguous == ["Ambiguous: which one"] and got[1].ambiguous == ["empty response"]


def test_no_cartesian_or_python_in_route_plan(spark, sf):
    plan = catalog.Q["flt_route_histogram"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Python" not in plan and "lang" in plan and "n_chars" not in plan


def test_stream_routes(spark, tmp_path):
    from clausework.streaming import routing

    rows = [(f"2024-01-01 00:00:0{k}", t) for k, t in enumerate(["The harbour opens at nine today.", "The harbour opens at nine today.", "See FM 3-0 for more on this.", "It may rain on the port."])]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "t string, text string").select(F.col("t").cast("timestamp").alias("t"), "text").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, text string").parquet(src)
    out = str(tmp_path / "out")
    q = routing.write_routes(routing.routed_stream(stream, time="t", text="text"), out, str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.route, r.text) for r in spark.read.parquet(out).collect()} == {("candidate", rows[0][1]), ("reject", rows[2][1]), ("abstain", rows[3][1])}
    assert spark.read.parquet(out).count() == 3


def test_deep_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(66)], "a string, b string")
    got = {(r.a, r.b): r.hops for r in K.closure(edges).where("a = 'n000'").collect()}
    assert len(got) == 66 and got["n000", "n066"] == 66
    known = spark.createDataFrame([("n066", 3)], "term string, arity int")
    up = KIF.inherited_arities(known, edges.selectExpr("a AS child", "b AS parent"))
    assert {r.arity for r in up.collect()} == {3}


def test_prepared_pins_whole_and_keeps_few_rows_a_task(spark):
    row = lambda p, k: (p, f"text {p} {k}", f"c{k}", f"k{k}")
    rows = [row(p, k) for p, n in (("a", 40), ("b", 3), (None, 9)) for k in range(n)]
    frame = lambda rs: spark.createDataFrame(rs, "pattern string, nl string, cnl string, kif string")
    out, pins = [row("a", 0), row("b", 1)], [row("a", k) for k in range(7)] + [row("b", 2)]
    for cap in (0, 5, 8, 20):
        got = P.prepared(frame(rows), frame(out), frame(pins), cap)
        want = []
        for p in ("a", "b", None):
            fixed = [r for r in pins if r[0] == p and r not in out]
            rest = sorted((r for r in rows if r[0] == p and r not in out + pins), key=lambda r: hashlib.md5(f"{r[1]}|{r[2]}".encode()).hexdigest())
            want += fixed + rest[: max(0, cap - len(fixed))]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
