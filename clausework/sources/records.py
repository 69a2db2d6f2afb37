"""Record files: JSON lines and CSV with required fields, unique ids and line numbers; writes in a fixed order, which never replace unless told to.

A read gives the good rows with their file and line, and the faults beside them, so that one bad line is told and not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kif import read_lines

#: Kinds of records: their schema, the fields that must be there and not blank, the field that must be unique, and what else must hold.
KINDS: dict[str, tuple[str, tuple[str, ...], str | None, dict[str, str]]] = {
    "sentence": ("sentence string, page_number int, position int, section string", ("sentence", "page_number", "position"), None, {}),
    "pair": ("nl string, cnl string, kif string, pattern string", ("nl", "cnl", "kif", "pattern"), None, {}),
    "class": ("term string, doc string", ("term",), None, {}),
    "relation": ("term string, arity int, signature map<string,string>, type string, doc string", ("term",), "term", {}),
    "fact": ("record_id string, kif string, cnl string, original string, page_number int, position int, section string, relation string, terms array<string>", ("record_id", "kif"), "record_id", {}),
    "source": ("record_id string, kif string, original string, status string, formalizable boolean", ("record_id", "kif", "original"), "record_id", {"draft": "status = 'draft'", "not formalizable": "NOT formalizable"}),
    "background": ("record_id string, kif string, rationale string", ("record_id", "kif", "rationale"), "record_id", {}),
    "benchmark": (
        "record_id string, doc_id string, page string, section string, nl string, formalizable boolean, pattern string, cnl string, kif string, terms array<string>, status string, split string", ("record_id", "doc_id", "nl", "status", "split"), "record_id",
        {"formalizable missing": "formalizable IS NULL", "status": "status NOT IN ('draft', 'reviewed', 'accepted')", "split": "split NOT IN ('seed', 'train', 'eval', 'abstain')", "abstention asserts": "NOT formalizable AND (pattern IS NOT NULL OR cnl IS NOT NULL OR kif IS NOT NULL)",
         "positive without form": "formalizable AND status <> 'draft' AND (cnl IS NULL OR kif IS NULL)"}),
}


def _checked(rows: DataFrame, required: tuple[str, ...], key: str | None, rules: dict[str, str]) -> DataFrame:
    """rows (with broken, file, line) and their faults as an array."""
    missing = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in required]
    named = [F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]
    out = rows.withColumn("faults", F.when(F.col("broken"), F.array(F.lit("not a record"))).otherwise(F.array_compact(F.array(*missing, *named))))
    if key:
        first = F.row_number().over(W.partitionBy(key).orderBy("file", "line"))
        out = out.withColumn("_n", first).withColumn("faults", F.when(F.col(key).isNotNull() & (F.col("_n") > 1), F.array_append("faults", F.lit(f"repeated {key}"))).otherwise(F.col("faults"))).drop("_n")
    return out


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of JSON lines with file, line and faults (empty for a good one). Blank lines are passed over."""
    schema, required, key, rules = KINDS[kind]
    lines = read_lines(spark, path).where(F.trim("text") != "")
    whole = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("_bad", T.StringType())])
    got = lines.select("file", "line", F.from_json("text", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return _checked(got.select("r.*", F.col("r._bad").isNotNull().alias("broken"), "file", "line").drop("_bad"), required, key, rules).drop("broken")


def good(records: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Records without faults in order of file and line, the first `limit` of them. A limit below one gives none."""
    out = records.where(F.size("faults") == 0).drop("faults")
    return out if limit is None else out.orderBy("file", "line").limit(max(0, limit))


def strict(records: DataFrame) -> DataFrame:
    """Records as they are, if none has a fault and there is one; else an error that names the first fault."""
    first = records.where(F.size("faults") > 0).orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}:{first[0].line}: {', '.join(first[0].faults)}")
    if records.isEmpty():
        raise ValueError("no records")
    return records.drop("faults")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quoted cells over several lines, and a mark at its start or none."""
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return got.toDF(*[c.lstrip("﻿") for c in got.columns])


def write(rows: DataFrame, path: str, *order: str | Column, form: str = "json", replace: bool = False) -> None:
    """Rows as JSON lines or CSV in the given order: range partitions, each a file, whose names sort alike."""
    out = rows.orderBy(*order) if order else rows
    to = out.write.mode("overwrite" if replace else "errorifexists")
    (to.json(path) if form == "json" else to.option("header", True).option("escape", '"').csv(path))
