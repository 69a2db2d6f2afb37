"""Exact Jaccard verification of candidates, group by group, without a list of pairs.

Candidates come as (g, u, e): a group, a unit and its set of 64-bit elements. Groups over BLOCK units are dealt in tiles of
two chunks. A tile gives a forest of its links, at most one row per unit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
_COLUMNS = 4096


def near_pairs(sets: list[np.ndarray], tenths: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (both orders) of sets whose Jaccard similarity is tenths / 10 or more, in whole numbers."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both and 10 * both >= tenths * (sizes.sum() - both)
        return (np.array([0, 1]), np.array([1, 0])) if hit else (np.zeros(0, int), np.zeros(0, int))
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[inverse]
    of, column = of[column >= 0], column[column >= 0]
    both = np.zeros((n, n), dtype=np.float32)  # counts under 2**24 are exact
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        m = np.zeros((n, min(_COLUMNS, top - at)), dtype=np.float32)
        m[of[a:b], column[a:b] - at] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    near = (both > 0) & (10 * both >= tenths * (sizes[:, None] + sizes[None, :] - both))
    np.fill_diagonal(near, False)
    return np.nonzero(near)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index by links a-b (given in both orders)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def tiled(units: DataFrame, crowded: DataFrame) -> DataFrame:
    """units (g, u, ...) with chunk c and tile (i, j). crowded: (g, m), the groups of more than BLOCK units with their numbers of chunks."""
    got = units.join(crowded, "g", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("u", "g"), F.col("m")).cast("int"))
    return got.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o", "m")


def crowds(units: DataFrame) -> DataFrame:
    return units.groupBy("g").count().where(F.col("count") > BLOCK).select("g", F.ceil(F.col("count") / BLOCK).cast("int").alias("m"))


def forest(dealt: DataFrame, parts: int, tenths: int = 8) -> DataFrame:
    """(a, b): links of a forest of each tile; dealt has g, i, j, u and e array<long>."""
    key = ["g", "i", "j"]
    rows = dealt.select(*key, "u", "e").repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches):
        held: list[tuple] = []
        now = None
        for batch in batches:
            g, i, j, u = (batch.column(c).to_numpy() for c in (*key, "u"))
            es = batch.column("e")
            flat, off = es.flatten().to_numpy(), es.offsets.to_numpy() - (es.offsets[0].as_py() if len(es.offsets) else 0)
            for k in range(batch.num_rows):
                at = (g[k], i[k], j[k])
                if at != now:
                    yield from judge(held)
                    held, now = [], at
                held.append((u[k], flat[off[k] : off[k + 1]].copy()))
        yield from judge(held)

    def judge(held):
        if len(held) < 2:
            return
        held.sort(key=lambda x: x[0])
        a, b = near_pairs([e for _, e in held], tenths)
        if not len(a):
            return
        root = roots_of(len(held), a, b)
        us = np.array([u for u, _ in held])
        out = np.flatnonzero(us[root] != us)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(us[out]), pa.array(us[root[out]])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")
