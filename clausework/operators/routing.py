"""Sentences to controlled statements by fixed frames: a frame yields slots, slots are resolved against the classes in joins, and a statement is written only if every slot has exactly one term."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .definitions import plain

#: Frames in order of trial. <1> <2> <3> are slots, <r> a relation named in the text, <role> one of four; "a" stands for a or an, "a?" for an optional one.
#: frame, template, relation (None: as named), whether the second slot must allow an agent
FRAMES = [
    ("for every <1>, the <r> relation holds with a <2>", "conditional_every", None, False),
    ("every <1> has a <2>", "conditional_every", "agent", True),
    ("every <1> can-have/has a <2> as its <role>", "conditional_every", None, False),
    ("the <r> relation holds between a <1> and a <2>", "binary", None, False),
    ("a <1> has a <2>", "binary", "agent", True),
    ("a <1> can-have a <2> as its <role>", "binary", None, False),
    ("a <1> can be located in a <2>", "binary", "located", False),
    ("it is not the case that the <r> relation holds between a <1> and a <2>", "negation_binary", None, False),
    ("a <1> does not have a <2>", "negation_binary", "agent", True),
    ("a <1> does not have a <2> as its <role>", "negation_binary", None, False),
    ("a <1> is not located in a <2>", "negation_binary", "located", False),
    ("the <r> relation holds among a <1>, a <2>, and a <3>", "nary", None, False),
    ("a? <1>, a? <2>, and a? <3> do not stand in the <r> relation", "negation_nary", None, False),
]
ROLES = "agent|patient|destination|origin"
AGENT = "AutonomousAgent"


def pattern(frame: str) -> tuple[str, dict[str, int]]:
    """The full-match pattern of a frame and the group of each slot."""
    several, groups, out = "<3>" in frame, {}, []
    last = max(k for k in ("<1>", "<2>", "<3>") if k in frame)
    for word in re.findall(r"<\w+>|\ba\?? |can-have/has|can-have|[^<]", frame):
        if word[0] == "<":
            name = word[1:-1]
            groups["r" if name == "role" else name] = len(groups) + 1
            final = word == last and frame.endswith(last)
            out.append({"r": "([a-z][a-z0-9]*)", "role": f"({ROLES})"}.get(name) or ("(.+)" if final else "(.+?)" if word == last or not several else "([^,]+)"))
        else:
            out.append({"a ": "(?:a|an) ", "a? ": "(?:(?:a|an) )?", "can-have/has": "(?:(?:can )?have|has)", "can-have": "(?:can )?have"}.get(word, re.escape(word) if not word.isspace() else " "))
    return "(?i)^" + "".join(out) + "$", groups


def prompt(text: Column) -> Column:
    """A sentence without the translation prefix, blanks squashed, final stops gone."""
    return F.regexp_replace(X.squash(F.regexp_replace(text, r"^(?i)\s*translate(\s+to\s+[A-Za-z0-9_]+)?\s*:\s*", "")), "[.!?]+$", "")


#: What a prompt that fits a frame or an enumeration holds.
MAY_FIT = r"(?i) (?:relation holds |ha(?:s|ve) an? |(?:can be|is not) located in an? |do not stand in the |consists? of |comprises? )"


def may_fit(text: Column) -> Column:
    """Whether a sentence may have a prediction: one pattern that every frame and the enumeration imply."""
    return F.regexp_like(prompt(text), F.lit(MAY_FIT))


def framed(text: Column) -> Column:
    """All frames that a prompt fits, as an array of (k, template, relation, guarded, slots), in order of trial."""
    found = []
    for k, (frame, template, relation, guarded) in enumerate(FRAMES):
        p, g = pattern(frame)
        rel = F.lit(relation) if relation else F.lower(F.regexp_extract(text, p, g["r"]))
        slots = F.array(*[F.regexp_extract(text, p, g[s]) for s in "123" if s in g])
        found.append(F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(k).alias("k"), F.lit(template).alias("template"), rel.alias("relation"), F.lit(guarded).alias("guarded"), slots.alias("slots"))))
    return F.array_compact(F.array(*found))


def resolved(phrases: DataFrame, classes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(phrase, terms) for each distinct phrase: its alias (phrase, term), else the classes of exactly its words, else all whose words are among its words.

    The last tier joins on each class's rarest word, so a word that many classes have makes no large group.
    """
    p = phrases.select("phrase").distinct().withColumn("key", plain(F.col("phrase")))
    c = classes.select("term").distinct().withColumn("key", plain(F.col("term"))).where("key <> ''")
    word = c.select("term", F.explode(F.array_distinct(X.words(F.col("key")))).alias("w"))
    rarest = word.join(word.groupBy("w").count(), "w").groupBy("term").agg(F.min_by("w", F.struct("count", "w")).alias("w"))
    part = c.withColumn("cw", F.array_distinct(X.words(F.col("key")))).select("term", "cw").join(rarest, "term")
    loose = p.withColumn("pw", F.array_distinct(X.words(F.col("key")))).withColumn("w", F.explode("pw")).join(part, "w").where(F.size(F.array_except("cw", "pw")) == 0).select("phrase", "term", F.lit(3).alias("tier"))
    hits = p.join(c, "key").select("phrase", "term", F.lit(2).alias("tier")).unionByName(loose)
    if aliases is not None:
        hits = hits.unionByName(p.join(aliases.select(F.col("phrase").alias("key"), "term"), "key").select("phrase", "term", F.lit(1).alias("tier")))
    by_tier = hits.groupBy("phrase", "tier").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return by_tier.groupBy("phrase").agg(F.min_by("terms", "tier").alias("terms"))


def route(rows: DataFrame, classes: DataFrame, relations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows (id, text) with template and cnl. The first fitting frame decides, even if it yields nothing; a guarded one only where its second slot may be an agent."""
    got = rows.select("id", prompt(F.col("text")).alias("_p")).select("id", F.explode(framed(F.col("_p"))).alias("f")).select("id", "f.*")
    slot = got.select("id", "k", F.posexplode("slots").alias("pos", "phrase"))
    slot = slot.join(resolved(slot, classes, aliases), "phrase", "left").select("id", "k", "pos", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    terms = slot.groupBy("id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "terms"))), lambda x: x["terms"]).alias("terms"))
    got = got.join(terms, ["id", "k"]).where(~F.col("guarded") | F.array_contains(F.element_at("terms", 2), AGENT))
    best = got.groupBy("id").agg(F.min_by(F.struct("template", "relation", "terms"), "k").alias("b")).select("id", "b.*")
    best = best.join(relations.select(F.col("term").alias("relation"), F.lit(True).alias("known")).distinct(), "relation", "left")
    one = F.when(F.col("known") & F.forall("terms", lambda t: F.size(t) == 1), F.flatten("terms"))
    a, b, r = one[0], one[1], F.col("relation")
    body = F.when(F.size(one) == 3, F.concat(r, F.lit(" [ "), F.array_join(one, " , "), F.lit(" ]"))).otherwise(F.concat_ws(" ", r, a, b))
    cnl = F.when(F.col("template") == "conditional_every", F.concat(F.lit("every ?x is-a "), a, F.lit(" implies "), r, F.lit(" ?x "), b)).when(F.startswith("template", F.lit("negation_")), F.concat(F.lit("not "), body)).otherwise(body)
    return rows.join(best.select("id", "template", F.when(one.isNotNull(), cnl).alias("cnl")), "id", "left")


def enumerations(rows: DataFrame, classes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows (id, text) with cnl where "P consists of A, B and C" and every part resolves: to one class, the widest that holds the head noun.

    Two different children or more, none the parent; conditions, negations and existence statements are refused.
    """
    frame = r"(?i)^(.+?)\s+(?:consists?\s+of|comprises?)\s+(.+)$"
    said = prompt(F.col("text"))
    shape = X.shapes(said)
    parts = F.filter(F.transform(F.split(F.regexp_extract(said, frame, 2), r"(?i);|,|\band\b"), lambda x: F.trim(x)), lambda x: x != "")
    got = rows.where(F.regexp_like(said, F.lit(frame)) & ~(shape["conditional"] | shape["negation"] | shape["existential"])).select("id", F.posexplode(F.concat(F.array(F.trim(F.regexp_extract(said, frame, 1))), parts)).alias("pos", "item"))
    got = got.withColumn("phrase", X.singular(F.col("item")))
    fits = resolved(got, classes, aliases).select("phrase", F.explode("terms").alias("term")).where(F.array_contains(F.split(plain(F.col("term")), " "), F.element_at(F.split(F.lower("phrase"), " "), -1)))
    width = F.size(F.split(plain(F.col("term")), " "))
    top = fits.groupBy("phrase", width.alias("n")).agg(F.count(F.lit(1)).alias("ties"), F.min("term").alias("term")).groupBy("phrase").agg(F.max_by(F.struct("ties", "term"), "n").alias("t")).where("t.ties = 1").select("phrase", "t.term")
    per = got.join(top, "phrase", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all"))
    names = F.transform("all", lambda x: x["term"])
    parent, children = names[0], F.array_distinct(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))))
    whole = ~F.exists(names, lambda t: t.isNull()) & ~F.array_contains(children, parent) & (F.size(children) >= 2)
    per = per.select("id", F.when(whole, F.array_join(F.transform(children, lambda c: F.concat(c, F.lit(" subclass-of "), parent)), " ")).alias("cnl"))
    return rows.join(per, "id", "left")


def predictions(rows: DataFrame, classes: DataFrame, relations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows (id, text) with cnl by the rules: an enumeration, else the first fitting frame."""
    listed = enumerations(rows, classes, aliases).select("id", F.col("cnl").alias("_listed"))
    return route(rows, classes, relations, aliases).join(listed, "id").withColumn("cnl", F.coalesce("_listed", "cnl")).drop("_listed")
