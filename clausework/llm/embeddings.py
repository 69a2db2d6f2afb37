"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors of a label are one class. A class's vector gets a code of k sign bits in each of several tables; vectors that
share a label and a code meet in a block, where exact cosines in double precision decide. A pair counts in the first
table in which its codes agree, so no list of pairs is made or made distinct: a block gives link counts and a forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_up, connected_components, counted, forget, owning, small_side, written

#: Vectors in a block at most; larger groups are tiled.
BLOCK = 1024


def plan(largest: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits and tables: codes so long that the largest label's random vectors fall 64 to a code, tables so many that a pair at the threshold is missed with chance `miss`."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(6, round(math.log2(max(largest, 1) / 64))) if largest > 64 else 6)
    return bits, math.ceil(math.log(miss) / math.log1p(-(p**bits)))


def near_vectors(rows: DataFrame, *, threshold: float = 0.93, seed: int = 5, miss: float = 1e-5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Links join rows of equal, non-null labels with cosine >= threshold. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null id or label, link with nothing and are components of their own. Vectors of
    other lengths never link. A repeated row is one more vector. Empty input: no rows.
    """
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # -0.0 and 0.0 are one component; the key stands for label and vector.
    plus = F.transform(e, lambda x: x.cast("double") + F.lit(0.0))
    as_stored = F.transform(e, lambda x: x + F.lit(0.0).cast(rows.schema["embedding"].dataType.elementType))
    keyed = rows.withColumn("_ok", F.coalesce(ok & fine, F.lit(False))).withColumn("_h1", F.when(F.col("_ok"), F.xxhash64("label", plus))).withColumn("_h2", F.when(F.col("_ok"), F.xxhash64(F.lit(7919), plus, F.col("label"))))
    classes = written(keyed.where("_ok").groupBy("_h1", "_h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by(as_stored, "vec_id").alias("v"), F.first("label").alias("label")), "veccls")
    sizes = classes.groupBy("label", F.size("v").alias("d")).count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    dims = sorted(r[0] for r in sizes.select("d").distinct().limit(1000).collect())
    bits, tables = plan(largest, threshold, miss)

    def codes_of(x: np.ndarray, planes: dict) -> np.ndarray:
        """A code for each vector and table."""
        d = x.shape[1]
        if d not in planes:
            planes[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, bits * tables))
        x = x.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in squares
        return ((x @ planes[d] >= 0).reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)

    names = ["t", "code", "label", "d", "rep", "copies"]

    def slim(batches):
        return coded(batches, False)

    def full(batches):
        return coded(batches, True)

    def coded(batches, whole):
        planes = {}
        for batch in batches:
            reps, copies, label = (batch.column(c).to_numpy() for c in ("rep", "copies", "label"))
            vs = batch.column("v")
            lens = np.diff(vs.offsets.to_numpy())
            flat = vs.flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(lens)))
            for d in np.unique(lens):
                mine = np.flatnonzero(lens == d)
                x = flat[at[mine][:, None] + np.arange(d)]
                code = codes_of(x, planes)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), t, np.int32)), pa.array(code[:, t]), pa.array(label[mine]), pa.array(np.full(len(mine), d, np.int32)), pa.array(reps[mine]), pa.array(copies[mine]),
                         *([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), int(d)).cast(vs.type)] if whole else [])], names=names + ["v"] * whole)

    if not dims:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    spread = classes.select("rep", "copies", "label", "v").repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = ["t", "label", "d", "code"]
    # Sizes of buckets first, from codes alone; vectors are then shuffled once a table, as they were stored.
    sizes = spread.mapInArrow(slim, "t int, code int, label long, d int, rep long, copies long").groupBy(*key).count()
    big, n_big = counted(sizes.where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("s")), "vecbig")
    coded_rows = spread.mapInArrow(full, f"t int, code int, label long, d int, rep long, copies long, v {classes.schema['v'].dataType.simpleString()}")
    met = coded_rows.join(small_side(big, n_big, 48), key, "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("rep", "t"), F.col("s")).cast("int"))
    # Chunk c meets every chunk, itself included: tile (i, j) with i <= j.
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
    tile = [*key, "i", "j"]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.select(*tile, "c", "rep", "copies", "v").repartition(parts, *tile).sortWithinPartitions(*tile, "rep")

    planes: dict = {}

    def verify(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in tile])
            cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and any(held[-1].column(c)[0] != batch.column(c)[a] for c in tile):
                    yield from judge(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from judge(held)

    def judge(held):
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.num_rows
        if n < 2:
            return
        rep, copies, c = (t[x].to_numpy() for x in ("rep", "copies", "c"))
        x = t["v"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        table, i, j = (t[x][0].as_py() for x in ("t", "i", "j"))
        raw = x
        x = x.astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= c[:, None] != c[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return
        if table:
            code = codes_of(raw, planes)
            new = ~(code[a, :table] == code[b, :table]).any(axis=1)
            a, b = a[new], b[new]
        if not len(a):
            return
        links = np.bincount(a, weights=copies[b], minlength=n).astype(np.int64)
        root = np.arange(n)
        while True:  # the smallest reachable row, by hooking and jumping
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        out = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(links[out]), pa.array(rep[root[out]])], names=["rep", "links", "root"])

    found = written(dealt.mapInArrow(verify, "rep long, links long, root long"), "vecfound")
    forget(big)
    comps = linked = connected_components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = written(
        classes.select("_h1", "_h2", "rep", "copies").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("_h1", "_h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vecout")
    forget(found, classes)
    clean_up(linked)
    out = keyed.select("vec_id", "_h1", "_h2").join(by_class, ["_h1", "_h2"], "left")
    comp = F.coalesce("component_id", "vec_id")
    return owning(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept")), by_class)


def op4(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
