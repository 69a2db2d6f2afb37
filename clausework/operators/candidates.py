"""The controlled statements that a prompt admits: as rows, as a test of one statement without listing any, and the choice among scored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .definitions import plain
from .routing import prompt, resolved

#: Variables, and the templates with the shapes of a prompt that they need. C is a class, R a relation, V a variable of the prompt's slots.
VARIABLES = ("?x", "?y", "?z", "?a", "?b", "?c")
TEMPLATES = [
    ("?x is-a C", ("copular",)), ("C subclass-of C", ("subclass",)), ("R V C", ()), ("R C V", ()), ("R C C", ()), ("not R V C", ("negation",)), ("not R C V", ("negation",)), ("not R C C", ("negation",)),
    ("R [ V , C , C ]", ("nary",)), ("R [ C , V , C ]", ("nary",)), ("R [ C , C , V ]", ("nary",)), ("R [ C , C , C ]", ("nary",)),
    ("not R [ V , C , C ]", ("nary", "negation")), ("not R [ C , V , C ]", ("nary", "negation")), ("not R [ C , C , V ]", ("nary", "negation")), ("not R [ C , C , C ]", ("nary", "negation")),
    ("every ?x is-a C implies R ?x C", ("conditional",)), ("if R ?x C then ?x is-a C", ("conditional",)), ("some ?x is-a C", ("existential",)), ("not ?x is-a C", ("negation", "copular")),
]
#: Parents too wide to be implied by a bare definition, and the wording of a definition.
WIDE_PARENTS = ("MilitaryProcess", "Procedure")
DEFINES = r"(?i)^(.+?)\s+(?:is|are|was|were)\s+((?:an?|the)\s+.*|intelligence(?:$|[^\p{L}\p{N}_]).*)$"
COPULA = r"(?i)^.+?\s+(?:is|are|was|were)\s+.+$"
SLOTS = 4


def slots(rows: DataFrame, classes: DataFrame, relations: DataFrame) -> DataFrame:
    """rows (id, text) with class_terms and relation_terms: those whose words stand in the text in a row. Texts outside the fragment have none, so no row is over 64 tokens."""
    said = prompt(F.col("text"))
    gram = rows.where(~X.unsupported(F.col("text"))).select("id", F.explode(X.ngrams(X.words(plain(said)))).alias("key"))
    vocabulary = classes.select("term", F.lit("c").alias("kind")).unionByName(relations.select("term", F.lit("r").alias("kind"))).distinct()
    hit = gram.join(vocabulary.withColumn("key", plain(F.col("term"))), "key")
    per = hit.groupBy("id").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(n) for k, n in (("c", "class_terms"), ("r", "relation_terms"))])
    none = F.array().cast("array<string>")
    return rows.join(per, "id", "left").withColumns({n: F.coalesce(n, none) for n in ("class_terms", "relation_terms")})


def _fits(template: str, needs: tuple[str, ...], shapes: dict[str, Column]) -> Column:
    """Whether a prompt admits a template: its shapes, and classes enough. Three-place templates and subclass need two classes, three class slots three."""
    places = template.split().count("C")
    least = places if "[" in template or "subclass-of" in template else 1
    ok = F.size("class_terms") >= least
    if "R" in template.split():
        ok &= F.size("relation_terms") >= 1
    for s in needs:
        ok &= shapes[s]
    return ok


def templates(rows: DataFrame) -> DataFrame:
    """rows of slots() with one row for each template that the prompt admits."""
    shapes = X.shapes(prompt(F.col("text")))
    return rows.withColumn("template", F.explode(F.array_compact(F.array(*[F.when(_fits(t, needs, shapes), F.lit(t)) for t, needs in TEMPLATES]))))


def language(rows: DataFrame, classes: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, template, cnl): all statements that a prompt admits. One slot is filled at a time, in a stream of rows; use admitted() where statements are given."""
    out = templates(slots(rows, classes, relations)).withColumn("cnl", F.col("template"))
    choices = {"R": F.col("relation_terms"), "C": F.col("class_terms"), "V": F.array(*map(F.lit, VARIABLES))}
    for _ in range(SLOTS):  # the leftmost open slot; a statement without one stays as it is
        kind = F.regexp_extract("cnl", r"(?:^| )([RCV])(?= |$)", 1)
        options = F.coalesce(*[F.when(kind == k, v) for k, v in choices.items()], F.array(F.lit("")))
        out = out.withColumn("_o", F.explode(options)).withColumn("cnl", F.when(F.col("_o") == "", F.col("cnl")).otherwise(_fill(F.col("cnl"), F.col("_o")))).drop("_o")
    return out.select("id", "template", "cnl")


def _fill(cnl: Column, term: Column) -> Column:
    """The leftmost open slot becomes the term. Filled ones are longer than a letter or end in another; a class of one letter would be taken for a slot."""
    tokens = F.split(cnl, " ")
    at = F.array_position(F.transform(tokens, lambda t: t.isin("R", "C", "V")), True).cast("int")
    return F.array_join(F.transform(tokens, lambda t, k: F.when(k == at - 1, term).otherwise(t)), " ")


def admitted(rows: DataFrame, classes: DataFrame, relations: DataFrame) -> DataFrame:
    """rows (id, text, cnl) with admitted: whether cnl is in the language of text, decided token by token without listing the language."""
    shapes = X.shapes(prompt(F.col("text")))
    tokens = F.split(F.regexp_replace(X.squash(F.col("cnl")), r"\.$", ""), " ")
    of = {"R": lambda t: F.array_contains("relation_terms", t), "C": lambda t: F.array_contains("class_terms", t), "V": lambda t: t.isin(*VARIABLES)}
    ways = []
    for template, needs in TEMPLATES:
        parts = template.split()
        ok = _fits(template, needs, shapes) & (F.size(tokens) == len(parts))
        for k, p in enumerate(parts):
            t = F.get(tokens, F.lit(k))
            ok &= of[p](t) if p in of else t == p
        ways.append(F.coalesce(ok, F.lit(False)))
    whole = ways[0]
    for w in ways[1:]:
        whole |= w
    return slots(rows, classes, relations).withColumn("admitted", whole)


def definition_language(rows: DataFrame) -> DataFrame:
    """(id, cnl) for rows (id, text, child, parents): the child is fixed, each other parent is offered, for copular prompts only."""
    return rows.where(F.regexp_like(prompt(F.col("text")), F.lit(COPULA))).select("id", "child", F.explode(F.array_distinct("parents")).alias("parent")).where("parent <> child").select("id", F.concat_ws(" subclass-of ", "child", "parent").alias("cnl"))


def implied(rows: DataFrame, classes: DataFrame, edges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, cnl) for rows (id, text) that define a class whose parent the background edges (child, parent) give; the longest class name first.

    Conditions, negations, existence and listings are refused; so are two wide parents.
    """
    said = prompt(F.col("text"))
    shape = X.shapes(said)
    got = rows.where(F.regexp_like(said, F.lit(DEFINES)) & ~(shape["existential"] | shape["conditional"] | shape["negation"] | shape["nary"])).select("id", F.regexp_extract(said, DEFINES, 1).alias("phrase"))
    term = got.join(resolved(got, classes, aliases), "phrase").select("id", F.explode("terms").alias("child"))
    edge = edges.where(~F.col("parent").isin(*WIDE_PARENTS))
    best = term.join(edge, "child").groupBy("id").agg(F.min_by(F.struct("child", "parent"), F.struct(-F.length("child"), "child")).alias("b"))
    return best.select("id", F.concat_ws(" subclass-of ", "b.child", "b.parent").alias("cnl"))


def licensed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (id, cnl, text) with licensed: a subclass statement that is a background edge, said of a class named in a definition."""
    p = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s+subclass-of\s+([A-Za-z][A-Za-z0-9_]*)\.?\s*$"
    got = rows.withColumns({"child": F.regexp_extract("cnl", p, 1), "parent": F.regexp_extract("cnl", p, 2)})
    known = edges.where(~F.col("parent").isin(*WIDE_PARENTS)).select("child", "parent", F.lit(True).alias("_edge")).distinct()
    src = F.lower(X.squash(F.col("text")))
    named = F.regexp_like(src, F.concat(F.lit("(^|[^a-z0-9])"), X.spaced(F.col("child")), F.lit("(s|es)?($|[^a-z0-9])")))
    defines = F.regexp_like(src, F.lit(r"(^|[^a-z0-9])(is|are|was|were)\s+((an?|the)\s|intelligence($|[^a-z0-9]))"))
    return got.join(known, ["child", "parent"], "left").withColumn("licensed", F.coalesce("_edge", F.lit(False)) & named & defines).drop("child", "parent", "_edge")


def best(scored: DataFrame, *, length_penalty: float = 1.15) -> DataFrame:
    """(id, cnl) for scored (id, cnl, logp, n_tokens): the statement with the largest logp over n_tokens to the penalty; ties by text."""
    rank = F.struct((F.col("logp") / F.pow(F.col("n_tokens").cast("double"), F.lit(length_penalty))).alias("s"), "cnl")
    return scored.where("n_tokens > 0 AND logp IS NOT NULL").groupBy("id").agg(F.max(F.struct(rank["s"].alias("s"), "cnl"))["cnl"].alias("cnl"))


def parent_choice(scored: DataFrame) -> DataFrame:
    """(id, raw_choice, calibrated_choice) for scored (id, seq, parent, raw, empty): by log-likelihood, and by what it gains over an empty prompt; ties go to the first by seq."""
    pick = lambda v, n: F.max_by("parent", F.struct(v, -F.col("seq"))).alias(n)
    return scored.groupBy("id").agg(pick(F.col("raw"), "raw_choice"), pick(F.col("raw") - F.col("empty"), "calibrated_choice"))


def vetoed(claims: DataFrame) -> DataFrame:
    """claims (logp_accept, logp_reject) with veto: the denial is likelier; a tie is no veto."""
    return claims.withColumn("veto", F.col("logp_reject") > F.col("logp_accept"))


def confidence(logits: Column) -> Column:
    """The mean over steps of the largest softmax share; NULL without steps."""
    top = F.transform(logits, lambda row: 1 / F.aggregate(F.transform(row, lambda x: F.exp(x - F.array_max(row))), F.lit(0.0), lambda a, x: a + x))
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top))
