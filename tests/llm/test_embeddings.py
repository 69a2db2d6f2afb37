from __future__ import annotations

import numpy as np

from clausework.llm import embeddings as E


def brute(rows, th=0.93):
    n = len(rows)
    ok = []
    for i, e, lab in rows:
        good = i is not None and lab is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        v = np.array(e, dtype=np.float64) if good else None
        ok.append(v / np.sqrt(v @ v) if good else None)
    links = [set() for _ in rows]
    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= th:
                links[a].add(b)
                links[b].add(a)
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in links[a]:
                if comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sorted((r[0] if r[0] is not None else -1, len(links[k]), comp[k] if comp[k] is not None else -1, comp[k] is not None and comp[k] == r[0]) for k, r in enumerate(rows))


def got(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in E.near_vectors(df).collect())


SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def rows_of(seed=0, groups=6, each=12, noise=0.25, d=16):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = r.standard_normal(d)
        for _ in range(each):
            out.append((len(out) * 7 % 1009, [float(np.float32(x)) for x in c + noise * r.standard_normal(d)], int(g % 3)))
    return out


def test_against_brute_force(spark):
    rows = rows_of()
    rows += [(2000 + k, rows[k][1], rows[k][2]) for k in range(5)] + [(2100, [x * 3 for x in rows[0][1]], rows[0][2]), (2101, rows[0][1], None), (2102, None, 1), (2103, [0.0] * 16, 1), (2104, [float("nan")] + [1.0] * 15, 1), (2105, [None] + [1.0] * 15, 1), (2106, [], 1), (2107, [1.0, 2.0], 1), (2108, [2.0, 4.0], 1), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert got(df) == brute(rows)


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 4)
    rows = rows_of(2, groups=2, each=30, noise=0.12)
    assert got(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)) == brute(rows)


def test_driver_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.op4(spark, sf).collect()) == brute(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)) == [(1, 0, 1, True)]
