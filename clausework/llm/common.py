"""What the operators share: scratch tables, whole-text keys, hashing in numpy and connected components."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
U = np.uint64


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset: a folder of our own if the master is this machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        root = "/tmp/clausework-scratch"
    return root.rstrip("/")


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write df once as Parquet into the shared folder and read it back, so a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._clausework_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_clausework_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def counted(df: DataFrame, name: str, size: Column | None = None) -> tuple[DataFrame, int] | tuple[DataFrame, int, int]:
    """df written, with its number of rows and, if a size is given, its sum."""
    out = written(df, name)
    if size is None:
        return out, out.count()
    return out, *out.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()


def owning(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these scratch tables; clean_up(df) deletes them when it is no longer needed."""
    df._clausework_owned = [x for t in tables for x in (t, *getattr(t, "_clausework_owned", []))]
    return df


def clean_up(df: DataFrame) -> None:
    """Delete the scratch tables that a result of these operators reads. The result can't be read after that."""
    forget(df, *getattr(df, "_clausework_owned", []))


#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, rows: int, width: int) -> DataFrame:
    """df with a broadcast hint if rows * width (both known beforehand) are within BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns of docs in one struct _row, which no name of ours can clash with, beside copies of those named."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *names)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes and the byte length of the whole text (null: empty), which stand for the text."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_h1"), F.xxhash64(F.lit(7919), t, F.lit("clausework")).alias("_h2")]


# ---------------------------------------------------------------- numpy hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective), for uint64 arrays."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def mix_int(x: int) -> int:
    x &= MASK
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(4096, 0xD1342543DE82EF95, dtype=np.uint64))
SHINGLE_WORDS = 5
_STEP = mix(np.arange(11, 11 + SHINGLE_WORDS, dtype=np.uint64)) | U(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes of all words (lower case, cut at ASCII white space) of all texts: hash, text number, start and end byte; the joined bytes."""
    parts = [("" if t is None else t).lower().encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts) + b"\n"
    b = np.frombuffer(data, dtype=np.uint8)
    word = b > 32
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return z.view(np.uint64), z, z, z, data
    at = np.arange(len(b), dtype=np.int64)
    at -= np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(b)]))))
    vals = _BYTE[b] * _POWER[at & 4095]
    vals[~word] = 0
    h = mix(np.add.reduceat(vals, start) + (end - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    return h, np.searchsorted(ends, start, side="right"), start, end, data


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each text, and the text's number, in order. A text of one to four words is one run; one without words has none."""
    h, doc, _, _, _ = word_hashes(texts)
    if not len(h):
        return h, doc
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    runs = np.where(n > 0, np.maximum(n - SHINGLE_WORDS + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + first[of]
    last = first[of] + n[of]
    out = np.zeros(len(of), dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        q = at + k
        out += np.where(q < last, h[np.minimum(q, len(h) - 1)], U(0)) * _STEP[k]
    return mix(out), of


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Components of the links (a, b), longs: rows (node, component), component being the smallest reachable node.

    Alternating large-star and small-star rounds, each written to the shared folder. A node's smallest neighbour is found
    by partial aggregation. Nodes of high degree (at most 2000 by the bound on degree) get theirs by broadcast, so no task
    gathers a hub's links. Self links and null ends are dropped. No links: no rows. Only counts come to the driver.
    """
    cur = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct(), "cc")
    for _ in range(max_rounds):
        n = cur.count()
        if not n:
            break
        # A forest of stars: no node has two parents, and no parent has one.
        twice = cur.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count()
        if not twice and not cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        used: list[DataFrame] = [cur]
        cur = written(_small_star(_large_star(cur, n, used), n, used), "cc")
        forget(*used)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return owning(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), cur)


def _with_min(pairs: DataFrame, n: int, used: list[DataFrame]) -> DataFrame:
    """pairs(u, v) with m, the smallest of u and its v. What is written goes on the list `used`."""
    least = written(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("k")), "ccmin")
    used.append(least)
    hub = max(64, n // 1000)
    hubs = least.where(F.col("k") > hub).select("u", "m")  # at most 2 n / hub rows
    rest = least.where(F.col("k") <= hub).select("u", "m")
    return pairs.join(F.broadcast(hubs), "u").unionByName(pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(rest, "u"))


def _large_star(cur: DataFrame, n: int, used: list[DataFrame]) -> DataFrame:
    both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
    got = _with_min(both, n, used)
    return got.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(cur: DataFrame, n: int, used: list[DataFrame]) -> DataFrame:
    got = _with_min(cur, n, used)
    return got.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u != v").distinct()
