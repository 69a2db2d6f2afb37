"""Mixing sources to target weights by Poisson replication, wholly in DataFrame functions.

Each source has a mean repetition rate: target weight times target size over what the source holds. Each document's count
is the inverse of the Poisson distribution function at a number hashed from the seed and its id. Documents are exploded
by their counts and dealt out by a hash of id, copy and place in the scan, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_side, written

#: A rate above this is drawn as a sum of equal parts, each inverted by itself.
PART_RATE = 64.0
_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) of 52 bits hashed from parts, the same in any SQL engine that has md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def rates(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """(_source, _n, _rate, _parts, _cdf) per source. weights: target shares (missing sources: 0; normalised); without them, a source of n documents has share n**alpha."""
    held = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(alpha))
    else:
        share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0)
    held = held.withColumn("_w", share)
    sums = held.agg(F.sum("_w").alias("_sw"), F.sum("_n").alias("_sn"))
    size = F.lit(float(total)) if total is not None else F.col("_sn").cast("double")
    out = held.crossJoin(F.broadcast(sums)).withColumn("_rate", F.when(F.col("_sw") > 0, F.col("_w") / F.col("_sw") * size / F.col("_n")).otherwise(0.0))
    out = out.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART_RATE)).cast("int")).withColumn("_r", F.col("_rate") / F.col("_parts"))
    return out.withColumn("_cdf", _cdf(F.col("_r"))).select("_source", "_n", "_rate", "_parts", "_cdf")


def _cdf(rate: Column) -> Column:
    """Poisson distribution function at 0, 1, ... as far as it differs from 1 in 52 bits."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 16).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), top), F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c")),
        lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c")))
    return steps["c"]


def replicate(docs: DataFrame, *, seed: int = 97, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """(_row, _rate, _copy, _place): the rows of docs, each repeated by its count, with copy numbers from 0 and hashed places in the global order.

    docs must be a deterministic scan. Null sources count as one source named ''. A row with a null id draws by its place in
    the scan. Rows that repeat an id draw the same count and are each repeated, at places of their own. Documents with
    count 0 go. A rate of 0 (no weight) gives no copies. An empty table gives an empty table. The rates (a row per source) are broadcast
    if their counted size is within the bound.
    """
    r = written(rates(docs, source_col=source_col, **how), "mix-rates")
    n, width = r.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_cdf")), F.lit(0))).first()
    rows = packed(docs).withColumn("_scan", F.monotonically_increasing_id()).withColumn("_source", F.coalesce(F.col(f"_row.`{source_col}`"), F.lit("")))
    joined = rows.withColumn("_id", F.coalesce(F.col(f"_row.`{id_col}`").cast("string"), F.concat(F.lit("row "), "_scan"))).join(small_side(r, n, 200 + 8 * width), "_source")
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")), F.lit(0),
        lambda a, k: a + F.size(F.filter(F.col("_cdf"), lambda c: c <= uniform(F.lit(seed), F.col("_id"), k))))
    first = F.size(F.filter(F.col("_cdf"), lambda c: c <= F.col("_u")))
    counted = joined.withColumn("_u", uniform(F.lit(seed), F.col("_id"), F.lit(1))).withColumn("_k", F.when(F.col("_parts") == 1, first).otherwise(draw)).where("_k > 0")
    out = counted.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return out.withColumn("_place", uniform(F.lit(seed + 1), F.col("_id"), F.col("_copy"), F.col("_scan"))).select("_row", "_rate", "_copy", "_place")


def shuffled(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows in global order of _place, which is uniform: a row's partition is its place scaled up, and no sample is drawn for ranges."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.floor(F.col("_place") * n).cast("int")).sortWithinPartitions("_place")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = shuffled(replicate(docs))
    return got.select("_row.doc_id", "_row.source", F.col("_copy").alias("copy"), F.round("_rate", 9).alias("rate"), F.octet_length("_row.text").cast("long").alias("n_bytes"))


OP10_SQL = """
WITH held AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM held) * (SELECT sum(n) FROM held)::DOUBLE / n AS rate FROM held),
cdf AS (
  SELECT s, rate, list_transform(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 16) AS BIGINT) + 1),
    lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate) - rate - lgamma(j + 1))))) AS c FROM r),
u AS (SELECT doc_id, source, text, coalesce(source, '') AS s, ('0x' || substr(md5('97:' || doc_id || ':1'), 1, 13))::BIGINT / pow(16, 13) AS u FROM documents),
k AS (SELECT doc_id, source, text, rate, unnest(range(0, len(list_filter(c, lambda x: x <= u)))) AS copy FROM u JOIN cdf USING (s))
SELECT doc_id, source, copy::INT AS copy, round(rate, 9) AS rate, strlen(text)::BIGINT AS n_bytes
FROM k
"""
