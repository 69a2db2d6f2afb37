"""The phrase baseline: claims of plain phrases are mapped to classes and relations by ranked look-ups and written as statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .definitions import plain

#: The shortest class and relation names that may match inside a phrase.
SHORTEST_CLASS, SHORTEST_RELATION = 4, 5
CLAIM = "pattern string, subject string, predicate string, object string, quantifier string, negated boolean"


def parse_claims(response: Column) -> Column:
    """Claims in a model's answer: the outermost JSON list or object, with or without text around it; NULL if there is none that parses."""
    body = F.regexp_extract(response, r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(F.startswith(body, F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return F.when(body != "", F.from_json(listed, f"array<struct<{CLAIM.replace(' string', ':string').replace(' boolean', ':boolean')}>>", {"mode": "PERMISSIVE"}))


def _runs(phrase: Column) -> Column:
    """All runs of words of a phrase."""
    w = X.words(plain(phrase))
    lengths = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " ")))))


def mapped(phrases: DataFrame, names: DataFrame, table: DataFrame, *, shortest: int, inside: bool) -> DataFrame:
    """(phrase, term) for each distinct phrase that maps.

    In this order: the table's longest key (phrase, term), inside the phrase if `inside` else equal to it; a name equal to the phrase;
    the longest name that ends the phrase (if `inside`); the longest name of `shortest` letters or more inside it. Ties go to the first name.
    """
    p = phrases.select("phrase").distinct().withColumn("whole", plain(F.col("phrase"))).where("whole <> ''")
    run = p.select("phrase", "whole", F.explode(_runs(F.col("phrase"))).alias("key"))
    said = F.col("key") == F.col("whole")
    by_table = run.join(table.select(plain(F.col("phrase")).alias("key"), "term").distinct(), "key").where(F.lit(inside) | said).select("phrase", "key", "term", F.lit(1).alias("tier"))
    tail = F.lit(inside) & F.endswith(F.col("whole"), F.concat(F.lit(" "), F.col("key")))
    tier = F.when(said, 2).when(tail, 3).when(F.length("key") >= shortest, 4)
    by_name = run.join(names.select(plain(F.col("term")).alias("key"), "term").distinct(), "key").select("phrase", "key", "term", tier.alias("tier")).where("tier IS NOT NULL")
    return by_table.unionByName(by_name).groupBy("phrase").agg(F.min_by("term", F.struct("tier", -F.length("key"), "key", "term")).alias("term"))


def map_claims(claims: DataFrame, classes: DataFrame, relations: DataFrame, phrases: DataFrame, verbs: DataFrame) -> DataFrame:
    """claims (id, pattern, subject, predicate, object, quantifier, negated) that map, with cnl and kif.

    "a is b" with two different classes becomes a subclass statement; an instance or existence claim takes the class of its subject, else of its object.
    """
    both = mapped(claims.select(F.explode(F.array("subject", "object")).alias("phrase")), classes, phrases, shortest=SHORTEST_CLASS, inside=True)
    verb = mapped(claims.select(F.col("predicate").alias("phrase")), relations, verbs, shortest=SHORTEST_RELATION, inside=False)
    got = claims.join(both.select(F.col("phrase").alias("subject"), F.col("term").alias("s")), "subject", "left").join(both.select(F.col("phrase").alias("object"), F.col("term").alias("o")), "object", "left").join(verb.select(F.col("phrase").alias("predicate"), F.col("term").alias("r")), "predicate", "left")
    said = F.lower("pattern")
    got = got.withColumn("pattern", F.when((said == "instance") & (F.col("s") != F.col("o")), "subclass").otherwise(said))
    got = got.withColumn("s", F.when(F.col("pattern").isin("instance", "existential"), F.coalesce("s", "o")).otherwise(F.col("s")))
    return got.withColumns(_statement()).where("cnl IS NOT NULL").select("id", "pattern", "cnl", "kif")


def _statement() -> dict[str, Column]:
    """cnl and kif of a mapped claim; NULL where its pattern lacks a term. A denied existence is written as stated."""
    s, o, r, no, p = F.col("s"), F.col("o"), F.col("r"), F.coalesce("negated", F.lit(False)), F.col("pattern")
    a, b = F.coalesce(s, F.lit("?x")), F.coalesce(o, F.lit("?y"))
    deny = lambda kif: F.when(no, F.concat(F.lit("(not "), kif, F.lit(")"))).otherwise(kif)
    say = lambda cnl: F.when(no, F.concat(F.lit("not "), cnl)).otherwise(cnl)
    form = lambda *parts: F.concat(F.lit("("), F.concat_ws(" ", *parts), F.lit(")"))
    member = form(F.lit("instance ?x"), s)
    every = s.isNotNull() & ((p == "conditional") | ((p == "relation") & (F.col("quantifier") == "universal")))
    link = (p == "relation") & (s.isNotNull() | o.isNotNull())
    rule = F.concat(F.lit("(forall (?x) (=> "), member, F.lit(" "), deny(form(r, F.lit("?x"), b)), F.lit("))"))
    cases = [
        (p == "instance", say(F.concat(F.lit("?x is-a "), s)), deny(member)),
        (p == "existential", F.concat(F.lit("some ?x is-a "), s), F.concat(F.lit("(exists (?x) "), member, F.lit(")"))),
        (p == "subclass", say(F.concat(s, F.lit(" subclass-of "), o)), deny(form(F.lit("subclass"), s, o))),
        (every & r.isNotNull(), F.concat(F.lit("every ?x is-a "), s, F.lit(" implies "), r, F.lit(" ?x "), b), rule),
        (link & r.isNotNull(), say(F.concat_ws(" ", r, a, b)), deny(form(r, a, b))),
    ]
    # concat_ws skips NULL, so each case asks for the terms it names
    needs = [s.isNotNull(), s.isNotNull(), s.isNotNull() & o.isNotNull(), F.lit(True), F.lit(True)]
    pick = lambda k: F.coalesce(*[F.when(c[0] & n, c[k]) for c, n in zip(cases, needs, strict=True)])
    return {"cnl": pick(1), "kif": pick(2)}
