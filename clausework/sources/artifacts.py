"""Artifacts as ordered line tables: knowledge bundles, theories for a prover with their evidence, and writes that never replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cnl as C
from ..plans.lineage import cut

#: The two rules of every theory, in the prover's syntax.
RULES = [("rule_subclass_transitivity", "![X,Y,Z]: ((subclass(X,Y) & subclass(Y,Z)) => subclass(X,Z))"), ("rule_instance_inheritance", "![X,Y,Z]: ((instance(X,Y) & subclass(Y,Z)) => instance(X,Z))")]


def numbered(rows: DataFrame, by: str, name: str = "number") -> DataFrame:
    """rows numbered from 0 in order of by, without bringing them into one task: range partitions, and an offset for each from their counts."""
    parts = cut(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offset = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return parts.join(offset, "_part").withColumn(name, (inside + F.col("_offset")).cast("long")).drop("_part", "_offset")


def theory(records: DataFrame) -> DataFrame:
    """(name, line, kind, record_id): axioms of records (seq, record_id, kind, kif) in order after the rules; unsupported formulas have no line."""
    lit = C.ground_literal(F.col("kif"))
    atom = F.concat(lit["relation"], F.lit("('"), lit["left"], F.lit("','"), lit["right"], F.lit("')"))
    formula = F.when(lit["negative"], F.concat(F.lit("~("), atom, F.lit(")"))).otherwise(atom)
    name = F.concat(F.lit("axiom_"), F.col("number").cast("string"))
    facts = numbered(records, "seq").select(name.alias("name"), F.concat(F.lit("fof("), name, F.lit(",axiom,("), formula, F.lit(")).")).alias("line"), "kind", "record_id")
    rules = [(n, f"fof({n},axiom,({f})).", "rule", None) for n, f in RULES]
    return records.sparkSession.createDataFrame(rules, "name string, line string, kind string, record_id string").unionByName(facts)


def bundle(records: DataFrame) -> DataFrame:
    """(seq, text): a comment with the provenance and the formula, for each record (seq, record_id, page, section, kif)."""
    said = F.concat_ws(" | ", F.col("record_id"), F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("None"))), F.concat(F.lit("section "), F.coalesce("section", F.lit(""))))
    return records.select("seq", F.concat(F.lit(";;; "), said, F.lit("\n"), F.trim("kif"), F.lit("\n")).alias("text"))


def metadata(records: DataFrame) -> DataFrame:
    """Provenance of each record as one struct under its id."""
    kept = [c for c in records.columns if c not in ("record_id", "seq")]
    return records.select("record_id", F.struct(*kept).alias("provenance"))


def write_once(df: DataFrame, path: str) -> None:
    """Parquet at a path that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)
