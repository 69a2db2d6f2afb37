"""Sharding by a two-pass external shuffle, under the law `rows`.

Pass one scatters records uniformly into buckets of bounded size with a seeded hash and counts the buckets. Pass two
shuffles each bucket in memory (Fisher-Yates) and numbers its rows after those of the buckets before it, so the whole
order is one random permutation. Shard s holds an equal share of consecutive places: counts differ by one at most.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed


def bucket_size(spark: SparkSession) -> int:
    """Bytes of text to a bucket: a sixteenth of an executor's memory for each of its cores, from 16 to 256 MB."""
    value = lambda k, d: spark.conf.get(k, None) or spark.sparkContext.getConf().get(k, d)
    size, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", value("spark.executor.memory", "1g").lower()).groups()
    share = (int(size) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)) // int(value("spark.executor.cores", "2")) // 16
    return min(256 << 20, max(16 << 20, share))


def shard(docs: DataFrame, *, n_shards: int = 16, seed: int = 20240117, bucket_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, shard int, slot long): the rows of docs with their shard and slot (gapless from 0 in each shard).

    docs must be a deterministic scan: a row's bucket hashes its id and its place in the scan, so that repeated rows, null
    ids or one id with a third of all rows scatter like any others; a bucket whose count differs between the passes stops
    the job. A bucket holds about bucket_bytes of text in memory (bucket_size() unless given). The driver keeps one count
    per bucket. Null texts count as one byte. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    total, rows = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1), F.count(F.lit(1))).first()
    rows_of = packed(docs)
    schema = T.StructType([*rows_of.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    if not rows:
        return spark.createDataFrame([], schema)
    n = max(1, -(-total // (bucket_bytes or bucket_size(spark))))
    keyed = rows_of.withColumn("_u", F.xxhash64(F.lit(seed), F.col(f"_row.`{id_col}`"), F.monotonically_increasing_id())).withColumn("_bucket", F.pmod("_u", F.lit(n)).cast("int"))
    counts = np.zeros(n, dtype=np.int64)
    for r in keyed.groupBy("_bucket").count().toLocalIterator():
        counts[r[0]] = r[1]
    before = np.cumsum(counts) - counts
    starts = np.array([-(-s * rows // n_shards) for s in range(n_shards + 1)], dtype=np.int64)

    def place(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        buckets = table["_bucket"].to_numpy()
        order = np.argsort(table["_u"].to_numpy(), kind="stable")
        for k in np.unique(buckets):
            mine = order[buckets[order] == k]
            if len(mine) != counts[k]:
                raise RuntimeError(f"bucket {k} has {len(mine)} rows, {counts[k]} were counted: the input is not a deterministic scan")
            np.random.Generator(np.random.PCG64([seed, int(k)])).shuffle(mine)  # Fisher-Yates
            at = before[k] + np.arange(len(mine))
            to = np.searchsorted(starts, at, side="right") - 1
            out = table.select(["_row"]).take(pa.array(mine)).append_column("shard", pa.array(to.astype(np.int32))).append_column("slot", pa.array(at - starts[to]))
            yield from out.to_batches(max_chunksize=2000)

    return keyed.repartitionById(n, F.col("_bucket")).mapInArrow(place, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; a bucket's rows touch one shard or two neighbours, so files stay large."""
    sharded.select("_row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.mode("overwrite").option("compression", "zstd").partitionBy("_shard").parquet(path)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = shard(docs)
    text = F.col("_row.text")
    return got.select(
        "_row.doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
