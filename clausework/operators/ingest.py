"""Sentences to routed statements, end to end: link, decompose, gate the input, predict, compile, ground, route, count."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import cnl as C
from ..functions import text as X
from ..plans.lineage import SMALL_BYTES, kept
from . import knowledge as K
from . import routing as R

# ---------------------------------------------------------------- entity linking

TOKEN = "[A-Za-z0-9_-]+"


def lookup(vocabulary: DataFrame, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """(_key, _term): lower-case tokens and the terms that they stand for. An abbreviation counts only if its term is in the vocabulary, and then goes before a term."""
    terms = vocabulary.groupBy(F.lower("term").alias("_key")).agg(F.min("term").alias("_term"))
    if not abbreviations:
        return terms
    short = vocabulary.sparkSession.createDataFrame([(k.lower(), v) for k, v in abbreviations.items()], "_key string, _term string")
    short = short.join(vocabulary.select(F.col("term").alias("_term")).distinct(), "_term", "left_semi").select("_key", "_term")
    return terms.join(short, "_key", "left_anti").unionByName(short)


def linked(rows: DataFrame, vocabulary: DataFrame, *, key: str, text: str, abbreviations: dict[str, str] | None = None) -> DataFrame:
    """rows (with a unique key) whose tokens that are terms in any case, or abbreviations of terms, become the terms. A token is a whole run of letters, digits, _ and -, so the longest match is the only one."""
    tokens = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))).alias("_key"))
    hits = tokens.join(lookup(vocabulary, abbreviations), "_key").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_term"))).alias("_to"))
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"{TOKEN}|[^A-Za-z0-9_-]+"), 0)
    again = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.col("_to"), F.lower(p)), p)), "")
    return rows.join(hits, key, "left").withColumn(text, F.when(F.col("_to").isNull(), F.col(text)).otherwise(again)).drop("_to")


# ---------------------------------------------------------------- decomposition

#: Words that begin a clause, and words that are a predicate.
CLAUSE_STARTS = "the|a|an|every|each|some|no|there|if|all|any|this|that|these|those|it|its|they|them|their|he|she|we|you"
PREDICATES = frozenset("is are was were be been being has have had do does did can could shall should will would may might must".split())
_KEPT_WHOLE = re.compile(r"\b(?:or|either|neither|nor|if|unless|not|no|never)\b|n['’]t\b", re.I)
_STARTS = re.compile(rf"(?:(?:{CLAUSE_STARTS}|[a-z][\w-]*)\b|\?[a-z_]\w*)", re.I)
_RELATIVE = re.compile(r"([^,;]+?),\s*(?:which|who|that)\s+([^,;]+?),\s*(.+)", re.I | re.S)
_COORDINATED = (re.compile(r"\s*,\s*(?:and|or|but)\s+", re.I), re.compile(r"\s+(?:and|or|but)\s+", re.I))


def sentence_of(part: str) -> str:
    """A part as a sentence of its own: no conjunction in front, a capital, a final stop."""
    part = re.sub(r"^(?:and|or|but)\s+", "", " ".join(part.split()), flags=re.I).strip(" ,;")
    if not part:
        return ""
    return (part[0].upper() if part[0].isalpha() else part[0]) + part[1:] + ("" if part[-1] in ".!?" else ".")


def independent(clause: str) -> bool:
    """Two tokens or more, a word in front, and among the later ones a predicate or a word in s, ed or ing."""
    first, *rest = clause.split() or [""]
    if not rest or not _STARTS.match(clause):
        return False
    bare = [w.strip(".,!?").lower() for w in rest]
    return any(w in PREDICATES or w.endswith(("s", "ed", "ing")) for w in bare)


def _parts(text: str) -> list[str]:
    """One split: at semicolons, at a relative clause, or at coordinated clauses that can all stand alone."""
    if _KEPT_WHOLE.search(text):
        return [text]
    relative = _RELATIVE.fullmatch(text)
    tries = [text.split(";")]
    if relative:
        head, clause, tail = relative.groups()
        tries.append([f"{head} {tail}", f"{head} {clause}"])
    for k, some in enumerate([*tries, *(c.split(text) for c in _COORDINATED)]):
        done = [s for s in map(sentence_of, some) if s]
        if len(done) > 1 and (k < len(tries) or all(independent(s.rstrip(".!?")) for s in done)):
            return done
    return [text]


def subclaims(text: str | None) -> list[str]:
    """All parts of a sentence, split again until nothing splits."""
    done: list[str] = []
    left = [sentence_of(text or "")]
    while left:
        now = left.pop()
        some = _parts(now) if now else []
        if some == [now]:
            done.append(now)
        else:
            left += reversed(some)
    return done


def _subclaims(texts: pd.Series) -> pd.Series:
    return texts.map(subclaims)


def decomposed(text: Column) -> Column:
    """The parts of a sentence that the controlled fragment may hold; splitting to the end is a work list, so a UDF."""
    return pandas_udf(_subclaims, "array<string>")(text)


def _linked_parts(terms: dict[str, str]) -> Callable[[pd.Series], pd.DataFrame]:
    """linked(), for terms that every task can hold, and the parts of what it gives."""
    token = re.compile(TOKEN)
    piece = re.compile(rf"{TOKEN}|[^A-Za-z0-9_-]+")

    def link(text: str) -> str:
        if text.isascii():
            return token.sub(lambda m: terms.get(m[0].lower(), m[0]), text)
        known = terms.keys() & set(token.findall(text.lower()))  # a sign may become a letter in lower case
        return piece.sub(lambda m: terms[m[0].lower()] if m[0].lower() in known else m[0], text) if known else text

    def run(texts: pd.Series) -> pd.DataFrame:
        said = [None if t is None else link(t) for t in texts] if terms else list(texts)
        return pd.DataFrame({"text": pd.Series(said, dtype=object), "parts": pd.Series([subclaims(t) for t in said], dtype=object)})

    return run


def _split_up(base: DataFrame, vocabulary: DataFrame, abbreviations: dict[str, str] | None) -> DataFrame:
    """base with _text linked and its _parts. A vocabulary of counted, small size is held by the tasks, so no row is shuffled; a larger one is met in joins."""
    terms = lookup(vocabulary, abbreviations).where("_key IS NOT NULL")
    size = terms.agg(F.coalesce(F.sum(F.length("_key") + F.length("_term") + 100), F.lit(0))).first()[0]
    held = {r["_key"]: r["_term"] for r in terms.collect()} if size <= SMALL_BYTES else {}
    rows = base if size <= SMALL_BYTES else linked(base, vocabulary, key="sentence_id", text="_text", abbreviations=abbreviations)
    got = rows.withColumn("_c", pandas_udf(_linked_parts(held), "text string, parts array<string>")("_text"))
    return got.withColumns({"_text": F.col("_c.text"), "_parts": F.col("_c.parts")}).drop("_c")


def _met(big: DataFrame, few: DataFrame, width: int, how: str) -> DataFrame:
    """big joined on _id with few, a stored table of rows about so wide; broadcast if that is small by count."""
    return big.join(F.broadcast(few) if few.count() * width <= SMALL_BYTES else few, "_id", how)


# ---------------------------------------------------------------- the chain


def rules(rows: DataFrame, classes: DataFrame, relations: DataFrame) -> DataFrame:
    """The predictor by fixed frames: (id, cnl) for rows (id, text) that may fit one; the others have none."""
    return R.predictions(kept(rows.where(R.may_fit(F.col("text"))), "ingest-asked"), classes, relations).select("id", "cnl")


def ingested(rows: DataFrame, classes: DataFrame, relations: DataFrame, *, abbreviations: dict[str, str] | None = None, aliases: dict[str, list[str]] | None = None, background: DataFrame | None = None, predictor: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = rules, normalizer: Callable[[Column], Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows (sentence_id, sentence) to one row for each subclaim: (sentence_id, k, sentence, subclaim, route, reason, cnl, kif, pattern, terms, ungrounded, record_id).

    classes: term. relations: term, arity. route is accepted, review (the gate's reason) or reject (noise, abstained,
    compile_error). A sentence with no supported part is one reject. Records are numbered in order of the compiled subclaims
    of their sentence. normalizer turns a sentence into the text to work on; predictor gives (id, cnl) for (id, text) and
    sees nothing else. The gate sees the sentence alone. Null sentences are empty, and noise. keep: further columns of rows.

    Linking, parts and gates of the input are one pass of each row by itself, stored; only what a predictor answers is joined.
    """
    said = F.coalesce("sentence", F.lit(""))
    base = rows.select("sentence_id", *keep, said.alias("sentence"), (normalizer(said) if normalizer else said).alias("_text"))
    vocabulary = classes.select("term").unionByName(relations.select("term")).distinct()
    numbered = F.transform("_parts", lambda x, k: F.struct(k.alias("k"), x.alias("subclaim")))
    good = F.filter(numbered, lambda p: ~F.coalesce(X.unsupported(p["subclaim"], squashed=True), F.lit(True)))  # parts are squashed
    parts = _split_up(base, vocabulary, abbreviations).select("sentence_id", *keep, "sentence", "_text", good.alias("_good"))
    some = F.size("_good") > 0
    whole = F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("subclaim")))
    parts = parts.select("sentence_id", *keep, "sentence", some.alias("_some"), F.explode(F.when(some, F.col("_good")).otherwise(whole)).alias("_p")).select("sentence_id", *keep, "sentence", "_some", "_p.*")
    parts = parts.withColumn("_s", X.squash(F.col("subclaim"))).withColumn("_noise", X.is_noise(F.col("_s"), squashed=True)).drop("_s")
    parts = kept(parts.withColumn("_id", F.concat_ws(" ", F.col("sentence_id").cast("string"), F.col("k").cast("string"))), "ingest-parts")
    asked = parts.where("_some AND NOT _noise").select(F.col("_id").alias("id"), F.col("subclaim").alias("text"))
    answered = kept(predictor(asked, classes, relations).where("cnl IS NOT NULL").select(F.col("id").alias("_id"), "cnl"), "ingest-answered")
    asked_of = _met(parts.select("_id", "sentence_id", "k", "sentence"), answered.select("_id").distinct(), 100, "left_semi")
    done = kept(C.compile_cnl(answered, classes, relations).select("_id", "cnl", "kif", "error").join(asked_of, "_id"), "ingest-compiled")
    terms = C.cnl_terms(F.col("cnl"))
    ready = done.where("error IS NULL").select(F.col("_id").alias("id"), "cnl", F.col("sentence").alias("source"), F.filter(terms, lambda t: F.regexp_like(t, F.lit("^[a-z]"))).alias("relations"), F.filter(terms, lambda t: F.regexp_like(t, F.lit("^[A-Z]"))).alias("classes"))
    judged = K.gate(ready, aliases=aliases, background=background).select(F.col("id").alias("_id"), "pattern", F.col("reason").alias("_why"), "ungrounded", F.concat("relations", "classes").alias("terms"))
    compiled = F.col("cnl").isNotNull() & F.col("error").isNull()
    ordinal = F.sum(compiled.cast("int")).over(W.partitionBy("sentence_id").orderBy("k")) - 1
    record = F.when(compiled, F.concat(F.col("sentence_id").cast("string"), F.lit("-n"), ordinal.cast("string")))
    told = kept(done.withColumn("record_id", record).drop("sentence_id", "k", "sentence").join(judged, "_id", "left"), "ingest-told")
    out = _met(parts, told, 1000, "left")
    reason = F.when(F.col("_noise"), "noise").when(F.col("cnl").isNull(), "abstained").when(F.col("error").isNotNull(), "compile_error").otherwise(F.col("_why"))
    route = F.when(~compiled, "reject").when(F.col("_why").isNull(), "accepted").otherwise("review")
    return out.select("sentence_id", *keep, "k", "sentence", "subclaim", route.alias("route"), reason.alias("reason"), "cnl", "kif", "pattern", "terms", "ungrounded", "record_id")


def run_counters(routed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of a run: subclaims, accepted, reviewed, rejects by reason, and the share accepted (0 if there are none)."""
    n = lambda c: F.count_if(c)
    why, route = F.col("reason"), F.col("route")
    return routed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("subclaims"), n(route == "accepted").alias("translated"), n(route == "review").alias("reviewed"), n(why == "abstained").alias("abstained"), n(why == "noise").alias("noise"),
        n(why == "compile_error").alias("compile_errors"), F.coalesce(F.try_divide(n(route == "accepted").cast("double"), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"))
