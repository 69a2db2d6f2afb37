"""Leakage and overlap audits, and validators that return the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def overlap(rows: DataFrame, known: DataFrame, *, text: str = "text", source: str = "source") -> DataFrame:
    """rows whose squashed, lower-case text is in known, with the sources that hold it."""
    k = known.select(X.text_key(F.col(text)).alias("_k"), F.col(source).alias("_s")).groupBy("_k").agg(F.array_sort(F.collect_set("_s")).alias("found_in"))
    return rows.withColumn("_k", X.text_key(F.col(text))).join(k, "_k").drop("_k")


def excluded(rows: DataFrame, sets: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """rows with excluded_by: the first of the named key sets that holds the row's key; NULL if none does."""
    out = rows
    for n, (name, keys) in enumerate(sets):
        out = out.join(keys.select(F.col(key)).distinct().withColumn(f"_x{n}", F.lit(name)), key, "left")
    return out.withColumn("excluded_by", F.coalesce(*[f"_x{n}" for n in range(len(sets))])).drop(*[f"_x{n}" for n in range(len(sets))])


def id_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, with that side; empty when the sets are equal."""
    left, right = a.select(key).distinct().withColumn("_l", F.lit(1)), b.select(key).distinct().withColumn("_r", F.lit(1))
    return left.join(right, key, "full_outer").where("_l IS NULL OR _r IS NULL").select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both runs whose values differ; NULL equals NULL."""
    return a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key).where("NOT (before <=> after)")


def violations(rows: DataFrame, key: str, rules: dict[str, object]) -> DataFrame:
    """(key, rule) for each row that breaks a rule; a rule is a condition that must not be true."""
    named = [F.when(c, F.lit(n)) for n, c in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*named))).alias("rule"))


#: What a reviewed claim may say of itself.
SPLITS, REVIEWERS, COVERAGE, DECISIONS = ("development", "eval"), ("ai", "human"), ("full", "partial"), ("positive", "abstain")


def packet_violations(claims: DataFrame, passages: DataFrame, pages: DataFrame, axioms: DataFrame, abstentions: list[str]) -> DataFrame:
    """(record_id, rule) for claims that break the contract of a claim packet.

    claims: record_id, doc_id, page, source_span, status, reviewer_type, reviewed_by, decision, abstention_reason, coverage, claim_text, cnl, kif, compiled (what cnl compiles to; NULL: it does not) and terms.
    passages: record_id, doc_id, page, excerpt. pages: page, text. axioms: kif.
    """
    said = passages.select("record_id", F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), "excerpt")
    rows = claims.join(said, "record_id", "left").join(pages.select("page", F.col("text").alias("_text")), "page", "left")
    rows = rows.join(axioms.select("kif", F.lit(True).alias("_axiom")).distinct(), "kif", "left").join(duplicates(claims, "record_id"), "record_id", "left")
    c, blank = F.col, lambda n: F.coalesce(F.trim(F.col(n)), F.lit("")) == ""
    positive, abstains = F.coalesce(c("decision") == "positive", F.lit(False)), F.coalesce(c("decision") == "abstain", F.lit(False))
    found = F.array_sort(F.filter(F.regexp_extract_all(c("cnl"), F.lit(r"(?:^|[ ])([A-Za-z][A-Za-z0-9_]*)(?=$|[ .])"), 1), lambda t: ~t.isin("every", "some", "no", "not", "if", "and", "then", "implies")))
    return violations(rows, "record_id", {
        "duplicate id": c("n").isNotNull(), "unknown id": c("excerpt").isNull(), "source reference": ~c("_doc").eqNullSafe(c("doc_id")) | ~c("_page").eqNullSafe(c("page")),
        "span not in excerpt": blank("source_span") | ~F.coalesce(F.contains("excerpt", "source_span"), F.lit(False)), "span not on page": ~F.coalesce(F.contains(X.squash(c("_text")), X.squash(c("source_span"))), F.lit(False)),
        "reviewer": ~(c("status").eqNullSafe(F.lit("reviewed")) & F.coalesce(c("reviewer_type").isin(*REVIEWERS), F.lit(False)) & ~blank("reviewed_by")), "decision": ~(positive | abstains),
        "abstention reason": abstains & ~F.coalesce(c("abstention_reason").isin(*abstentions), F.lit(False)), "abstention asserts": abstains & ~(blank("claim_text") & blank("cnl") & blank("kif")),
        "coverage": positive & ~F.coalesce(c("coverage").isin(*COVERAGE), F.lit(False)), "incomplete": positive & (blank("claim_text") | blank("cnl")), "compiled": positive & ~c("compiled").eqNullSafe(c("kif")),
        "preloaded": positive & c("_axiom").isNotNull(), "terms": positive & ~F.coalesce(F.array_distinct(found) == F.array_sort(F.array_distinct("terms")), F.lit(False)),
    })


def registry_violations(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """(symbol, rule) for registry entries (alias, evidence_cue, symbol, declaration): blank parts, ill-formed, known or repeated symbols, repeated aliases, another declaration than that of a class."""
    alias = F.lower(X.squash(F.col("alias")))
    rows = entries.withColumn("_a", alias).join(classes.select(F.col("term").alias("symbol"), F.lit(True).alias("_known")).distinct(), "symbol", "left")
    rows = rows.join(duplicates(rows, "symbol").withColumnRenamed("n", "_ns"), "symbol", "left").join(duplicates(rows, "_a").withColumnRenamed("n", "_na"), "_a", "left")
    blank = lambda n: F.coalesce(F.trim(F.col(n)), F.lit("")) == ""
    return violations(rows, "symbol", {
        "blank": blank("alias") | blank("evidence_cue"), "symbol form": ~F.regexp_like("symbol", F.lit("^[A-Z][A-Za-z0-9]*$")), "known class": F.col("_known").isNotNull(), "repeated symbol": F.col("_ns").isNotNull(), "repeated alias": F.col("_na").isNotNull(),
        "declaration": ~F.col("declaration").eqNullSafe(F.concat(F.lit("(instance "), F.col("symbol"), F.lit(" Class)"))),
    })


def run_violations(predictions: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, rule) for a prediction run: predictions (record_id, source_sha256, span_start, span_end, span, evidence) against sources (record_id, text); ends are exclusive, places count from 0."""
    rows = predictions.join(sources.select("record_id", F.col("text").alias("_t")), "record_id", "full").join(duplicates(predictions, "record_id"), "record_id", "left")
    c = F.col
    given = c("source_sha256").isNotNull()
    return violations(rows, "record_id", {
        "no prediction": ~given, "unknown source": c("_t").isNull(), "repeated": c("n").isNotNull(), "source changed": given & (F.sha2(F.encode("_t", "UTF-8"), 256) != c("source_sha256")),
        "span": c("span").isNotNull() & ~F.coalesce(F.substring(c("_t"), c("span_start") + 1, c("span_end") - c("span_start")) == c("span"), F.lit(False)), "evidence": c("evidence").isNotNull() & ~F.coalesce(F.contains("_t", "evidence"), F.lit(False)),
    })


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def preflight(facts: DataFrame, blockers: dict[str, object]) -> DataFrame:
    """One row: the blockers that hold, and whether any does."""
    got = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in blockers.items()]))
    return facts.select(got.alias("blockers"), (F.size(got) > 0).alias("blocked"))


def partition_verdict(used: DataFrame, sides: list[str]) -> DataFrame:
    """Counts of keys on each side only, on both, and on neither; used has a boolean column for each of two sides."""
    a, b = (F.col(s) for s in sides)
    return used.agg(F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
