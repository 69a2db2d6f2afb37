"""Training pairs: generators over a vocabulary, and sampling without a random stream (hash order gives the same counts)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.artifacts import numbered


def _rows(df: DataFrame, pattern: str, nl: list[Column], cnl: Column, kif: Column) -> DataFrame:
    return df.select(F.lit(pattern).alias("pattern"), F.explode(F.array(*nl)).alias("nl"), cnl.alias("cnl"), kif.alias("kif"))


def _noun(term: str) -> tuple[Column, Column]:
    n = X.spaced(F.col(term))
    return n, F.concat_ws(" ", X.article(n), n)


#: Wordings of our own. {1} is a class as written, {1n} in words, {1a} in words with its article, {1A} that with a capital; {r} is a relation.
INSTANCE_WORDINGS = [
    "Here we have {1a}.", "What you see is {1a}.", "This counts as {1a}.", "It was listed as {1a}.", "The item at hand is {1a}.", "One would call it {1a}.", "Its class is {1n}.", "The record describes {1a}.", "The object in question is {1a}.",
    "That is surely {1a}.", "We speak of {1a}.", "The thing found is {1a}.", "It belongs to the class {1}.",
]
EXISTENTIAL_WORDINGS = [
    "There is {1a}.", "There exists {1a}.", "{1A} exists.", "At least one {1n} exists.", "Some {1n} can be found.", "Somewhere there is {1a}.", "One {1n} or more can be found.", "The world has {1a}.", "Among all things is {1a}.", "Something is {1a}.",
    "We know of {1a}.", "{1A} can be found.", "Some member of the class {1} exists.",
]
DENIED_WORDINGS = ["This is no {1n}.", "It does not count as {1a}.", "What you see is not {1a}.", "The item at hand is not {1a}.", "One would not call it {1a}."]
EDGE_WORDINGS = ["{1} falls under {2}.", "Each {1} counts as a {2}.", "All of {1} lies inside {2}.", "{1A} is one sort of {2n}.", "To be {1a} is to be {2a}.", "Each {1n} counts as {2a}.", "The class of {1n} lies inside that of {2n}."]
BINARY_OPEN_WORDINGS = ["Two things are linked by {r}.", "One thing bears {r} to another.", "Some pair of things has {r}."]
BINARY_WORDINGS = ["{1A} bears {r} to {2a}.", "Between {1a} and {2a} there is {r}.", "{1A} and {2a} are linked by {r}.", "By {r}, {1a} is tied to {2a}.", "The pair of {1} and {2} has {r}.", "{r} leads from {1a} to {2a}."]
EVERY_WORDINGS = ["Each {1n} bears {r} to {2a}.", "Whatever is {1a} bears {r} to {2a}.", "From each {1n}, {r} leads to {2a}.", "All of {1} is tied to {2} by {r}.", "Take any {1n}: by {r} it is tied to {2a}."]
BINARY_DENIED_WORDINGS = ["{1A} does not bear {r} to {2a}.", "Between {1a} and {2a} there is no {r}.", "The pair of {1} and {2} lacks {r}."]
OPEN_TERNARY_WORDINGS = ["Three things share {r}.", "A triple of things has {r}.", "By {r}, three things are tied together."]
TERNARY_WORDINGS = ["{1A}, {2a} and {3a} share {r}.", "By {r}, {1a}, {2a} and {3a} are tied together.", "The triple of {1}, {2} and {3} has {r}.", "There is {r} for {1a} with {2a} and {3a}.", "{r} ties {1a} to {2a} and {3a}."]
TERNARY_DENIED_WORDINGS = ["{1A}, {2a} and {3a} do not share {r}.", "The triple of {1}, {2} and {3} lacks {r}."]
IF_WORDINGS = ["Whatever bears {r} to {2a} is {1a}.", "Once a thing bears {r} to {2}, it falls under {1}.", "Only {1a} bears {r} to {2a}.", "A thing that {r} leads from to {2a} is {1a}.", "Where {r} leads to {2a}, it starts at {1a}."]
TOP = "Entity"


def worded(template: str, relation: str = "term", classes: tuple[str, ...] = ("a", "b", "c")) -> Column:
    """A wording as a Column over a relation column and class columns."""
    out = []
    for part in re.split(r"(\{\w+\})", template):
        if not part.startswith("{"):
            out.append(F.lit(part))
        elif part == "{r}":
            out.append(F.col(relation))
        else:
            name = classes[int(part[1]) - 1]
            noun, with_article = _noun(name)
            out.append({"n": noun, "a": with_article, "A": X.upper_first(with_article)}.get(part[2], F.col(name)))
    return F.concat(*out)


def _wordings(templates: list[str], *classes: str) -> list[Column]:
    return [worded(t, classes=classes or ("a", "b", "c")) for t in templates]


def instance_pairs(classes: DataFrame) -> DataFrame:
    """Instance pairs of classes (term, and doc if there is one: it is a wording of its own where it is not empty)."""
    t = F.col("term")
    cnl, kif = F.concat(F.lit("?x is-a "), t), F.concat(F.lit("(instance ?x "), t, F.lit(")"))
    out = _rows(classes, "instance", _wordings(INSTANCE_WORDINGS, "term"), cnl, kif)
    return out.unionByName(_rows(classes.where("doc <> ''"), "instance", [F.col("doc")], cnl, kif)) if "doc" in classes.columns else out


def existential_pairs(classes: DataFrame) -> DataFrame:
    t = F.col("term")
    return _rows(classes, "existential", _wordings(EXISTENTIAL_WORDINGS, "term"), F.concat(F.lit("some ?x is-a "), t), F.concat(F.lit("(exists (?x) (instance ?x "), t, F.lit("))")))


def negation_pairs(classes: DataFrame) -> DataFrame:
    t = F.col("term")
    return _rows(classes, "negation", _wordings(DENIED_WORDINGS, "term"), F.concat(F.lit("not ?x is-a "), t), F.concat(F.lit("(not (instance ?x "), t, F.lit("))")))


def adjacent(classes: DataFrame, seq: str = "seq") -> DataFrame:
    """(child, parent): each class and the next in order of seq, whatever its gaps; the order is numbered in parts, so no task sorts all."""
    rows = numbered(classes.select("term", seq), seq, "k")
    return rows.select("term", "k").join(rows.select(F.col("term").alias("parent"), (F.col("k") - 1).alias("k")), "k").select(F.col("term").alias("child"), "parent")


def subclass_pairs(edges: DataFrame) -> DataFrame:
    """Subclass pairs for (child, parent), true edges or adjacent classes."""
    return _rows(edges, "subclass", _wordings(EDGE_WORDINGS, "child", "parent"), F.concat_ws(" subclass-of ", "child", "parent"), F.concat(F.lit("(subclass "), F.concat_ws(" ", "child", "parent"), F.lit(")")))


def relation_pairs(relations: DataFrame, signature: DataFrame, narrower: DataFrame) -> DataFrame:
    """Binary (open and typed), conditional and denied pairs for relations of two arguments, for each typed pair of classes."""
    t, two = F.col("term"), typed(relations, signature, 2, narrower)
    form = lambda *x: F.concat(F.lit("("), F.concat_ws(" ", "term", *x), F.lit(")"))
    free = [F.lit("?x"), F.lit("?y")]
    opened = _rows(relations.where("arity = 2"), "binary", _wordings(BINARY_OPEN_WORDINGS), F.concat_ws(" ", "term", *free), form(*free))
    binary = _rows(two, "binary", _wordings(BINARY_WORDINGS), F.concat_ws(" ", "term", "a", "b"), form("a", "b"))
    body = F.concat_ws(" ", t, F.lit("?x"), F.col("b"))
    every = _rows(two, "conditional", _wordings(EVERY_WORDINGS), F.concat(F.lit("every ?x is-a "), F.col("a"), F.lit(" implies "), body), F.concat(F.lit("(forall (?x) (=> (instance ?x "), F.col("a"), F.lit(") ("), body, F.lit(")))")))
    denied = _rows(two, "negation", _wordings(BINARY_DENIED_WORDINGS), F.concat_ws(" ", F.lit("not"), "term", "a", "b"), F.concat(F.lit("(not "), form("a", "b"), F.lit(")")))
    return opened.unionByName(binary).unionByName(every).unionByName(denied)


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Subclass pairs for true edges (child, parent)."""
    return subclass_pairs(edges.distinct())


def typed(relations: DataFrame, signature: DataFrame, arity: int, narrower: DataFrame) -> DataFrame:
    """(term, a, b, ...): a relation's argument classes, each also by its narrower classes (wide, narrow); a missing or odd class counts as the top.

    One argument is expanded at a time by a join on its class, so a relation makes the product of its own expansions and no more.
    """
    out = relations.where(F.col("arity") == arity).select("term")
    ways = signature.select("class").unionByName(narrower.select(F.col("wide").alias("class"))).unionByName(out.sparkSession.range(1).select(F.lit(TOP).alias("class"))).distinct()
    ways = ways.select("class", F.col("class").alias("narrow")).unionByName(narrower.select(F.col("wide").alias("class"), "narrow")).distinct()
    for k, name in enumerate("abc"[:arity], 1):
        kind = signature.where(F.col("position") == k).groupBy("term").agg(F.min("class").alias("class"))
        out = out.join(kind, "term", "left").withColumn("class", F.when(F.regexp_like("class", F.lit("^[A-Z][A-Za-z0-9]*$")), F.col("class")).otherwise(TOP)).join(ways, "class").withColumnRenamed("narrow", name).drop("class")
    return out.distinct()


def ternary_pairs(relations: DataFrame, signature: DataFrame, narrower: DataFrame) -> DataFrame:
    """Pairs for relations of three arguments: open, and for each typed triple of classes."""
    listed = lambda *x: F.concat(F.col("term"), F.lit(" [ "), F.concat_ws(" , ", *x), F.lit(" ]"))
    form = lambda *x: F.concat(F.lit("("), F.concat_ws(" ", "term", *x), F.lit(")"))
    free = [F.lit(v) for v in ("?x", "?y", "?z")]
    abstract = _rows(relations.where("arity = 3"), "nary", _wordings(OPEN_TERNARY_WORDINGS), listed(*free), form(*free))
    three = typed(relations, signature, 3, narrower)
    said = _rows(three, "nary", _wordings(TERNARY_WORDINGS), listed("a", "b", "c"), form("a", "b", "c"))
    denied = _rows(three, "negation", _wordings(TERNARY_DENIED_WORDINGS), F.concat(F.lit("not "), listed("a", "b", "c")), F.concat(F.lit("(not "), form("a", "b", "c"), F.lit(")")))
    return abstract.unionByName(said).unionByName(denied)


def if_pairs(relations: DataFrame, signature: DataFrame, narrower: DataFrame) -> DataFrame:
    """If-then pairs: what stands in a relation to a class is of another class."""
    head, body = F.concat(F.lit("if "), F.col("term"), F.lit(" ?x "), F.col("b")), F.concat(F.lit("?x is-a "), F.col("a"))
    kif = F.concat(F.lit("(=> ("), F.col("term"), F.lit(" ?x "), F.col("b"), F.lit(") (instance ?x "), F.col("a"), F.lit("))"))
    return _rows(typed(relations, signature, 2, narrower), "conditional", _wordings(IF_WORDINGS), F.concat_ws(" then ", head, body), kif)


def minimal_pairs(aliases: DataFrame, variants: DataFrame) -> DataFrame:
    """One definition for each alias and variant (parent, cue, tail): they differ in the genus alone. The variants are a short written list, so they are exploded, not joined."""
    listed = variants.agg(F.array_sort(F.collect_list(F.struct("parent", "cue", "tail"))).alias("v"))
    subject = X.upper_first(F.col("alias"))
    got = aliases.select("alias", F.lit(1).alias("_k")).join(F.broadcast(listed.withColumn("_k", F.lit(1))), "_k").select("alias", F.explode("v").alias("v"))
    return got.select("alias", X.pascal(F.lower("alias")).alias("symbol"), F.col("v.parent").alias("stated_parent"), F.concat_ws(" ", subject, F.col("v.tail")).alias("sentence"), F.concat_ws(" ", subject, F.col("v.cue")).alias("candidate_text"))


def prepared(rows: DataFrame, excluded: DataFrame, pinned: DataFrame, cap: int) -> DataFrame:
    """rows (pattern, nl, cnl, kif) without texts of `excluded` (nl); pinned rows stay whatever the cap, others fill each pattern up to it.

    Pinned rows are only counted. The window is over the others and keeps a bare cap, so that each task drops all but its
    first rows of a pattern before the shuffle (Spark does so for caps up to spark.sql.optimizer.windowGroupLimitThreshold).
    """
    key = lambda df: df.withColumn("_k", F.lower(X.squash(F.col("nl"))))
    out = key(excluded).select("_k").distinct()
    fixed = key(pinned).join(out, "_k", "left_anti")
    pool = key(rows).join(out.unionByName(fixed.select("_k")).distinct(), "_k", "left_anti").select("pattern", "nl", "cnl", "kif")
    first = pool.withColumn("_n", F.row_number().over(W.partitionBy("pattern").orderBy(F.md5(F.concat_ws("|", "nl", "cnl"))))).where(F.col("_n") <= cap)
    held = fixed.groupBy(F.col("pattern").alias("_p")).agg(F.count(F.lit(1)).alias("_held"))
    free = first.join(held, F.col("pattern").eqNullSafe(F.col("_p")), "left").where(F.col("_n") + F.coalesce("_held", F.lit(0)) <= cap)
    return fixed.select("pattern", "nl", "cnl", "kif").unionByName(free.select("pattern", "nl", "cnl", "kif"))


def balanced(rows: DataFrame, cap: int, *, by: str = "pattern", order: list | None = None) -> DataFrame:
    """At most cap rows of each group, in hash order unless another is given; short groups are not filled up from others."""
    w = W.partitionBy(by).orderBy(*(order or [F.md5(F.concat_ws("|", "nl", "cnl"))]))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def grouped_split(rows: DataFrame, share: int, *, key: list[str], order: Column) -> DataFrame:
    """rows with split: whole groups, in hash order, go to validation while the rows before them are under share percent of all; the last group trains."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    parts = numbered(sizes.withColumn("_o", F.struct("o", *key)), "_o", "k")
    # Running sums by parts of the numbers, then the parts' sums before them: no task sees all groups.
    block = F.floor(F.col("k") / 10_000)
    whole = parts.groupBy(block.alias("_b")).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_groups"))
    ahead = whole.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_ahead"))  # a row for each 10,000 groups
    total = whole.agg(F.sum("_n").alias("_total"), F.sum("_groups").alias("_groups"))
    inside = F.sum("n").over(W.partitionBy("_b").orderBy("k")) - F.col("n")
    sized = parts.withColumn("_b", block).withColumn("_inside", inside).join(ahead, "_b").crossJoin(F.broadcast(total))  # one row
    first = ((F.col("_inside") + F.col("_ahead")) * 100 < F.col("_total") * share) & (F.col("k") < F.col("_groups") - 1)
    return rows.join(sized.select(*key, F.when(first, "validation").otherwise("train").alias("split")), key)
