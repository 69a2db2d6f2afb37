"""Reasoning over ground literals, facet retrieval, and the grounding gate."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cnl as C
from ..functions import text as X
from ..plans.lineage import cut


def closure(pairs: DataFrame) -> DataFrame:
    """Transitive closure of (a, b) with the length of a shortest path and one such path. Cycles are fine: only new pairs are followed, until there are none."""
    start = pairs.select("a", "b").distinct().select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("path"))
    done = fresh = cut(start)
    step = start.select(F.col("a").alias("b"), F.col("b").alias("to"))
    for k in count(2):
        nxt = fresh.join(step, "b").groupBy("a", "to").agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        nxt = cut(nxt.select("a", F.col("to").alias("b"), F.lit(k).alias("hops"), "path").join(done.select("a", "b"), ["a", "b"], "left_anti"))
        if nxt.isEmpty():
            return done
        done, fresh = cut(done.unionByName(nxt)), nxt


def answers(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """questions (id, relation, left, right, negative) with status, by joins with the closure of facts (relation, left, right, negative).

    A question that is unsupported or names an unknown term is unknown, even over an inconsistent theory. Else a
    contradiction makes every answer inconsistent. Else a positive atom is proven if it follows, and disproven if it would
    make a stated negative follow; a negative question swaps the two.
    """
    pos, neg = facts.where("NOT negative"), facts.where("negative")
    sub = closure(pos.where("relation = 'subclass'").select(F.col("left").alias("a"), F.col("right").alias("b"))).select("a", "b")
    inst = pos.where("relation = 'instance'").select(F.col("left").alias("a"), F.col("right").alias("c"))
    follows = sub.select(F.lit("subclass").alias("relation"), F.col("a").alias("left"), F.col("b").alias("right"))
    inherited = inst.join(sub.withColumnRenamed("a", "c"), "c").select("a", "b").unionByName(inst.select("a", F.col("c").alias("b"))).distinct()
    follows = cut(follows.unionByName(inherited.select(F.lit("instance").alias("relation"), F.col("a").alias("left"), F.col("b").alias("right"))))
    broken = neg.join(follows, ["relation", "left", "right"], "left_semi").agg((F.count(F.lit(1)) > 0).alias("broken"))
    terms = facts.select(F.explode(F.array("left", "right")).alias("t")).distinct()
    q = questions.join(terms.select(F.col("t").alias("left"), F.lit(True).alias("kl")), "left", "left").join(terms.select(F.col("t").alias("right"), F.lit(True).alias("kr")), "right", "left")
    q = q.join(follows.withColumn("yes", F.lit(True)), ["relation", "left", "right"], "left")
    # Adding x -> y makes u -> v follow for u at or below x and v at or above y, and i : v for instances i of such u.
    up = sub.unionByName(terms.select(F.col("t").alias("a"), F.col("t").alias("b")))
    below_neg = neg.join(up.select(F.col("a").alias("left"), F.col("b").alias("x")), "left").where("relation = 'subclass'")
    hit_sub = below_neg.join(up.select(F.col("a").alias("y"), F.col("b").alias("right")), "right").select(F.lit("subclass").alias("relation"), F.col("x").alias("left"), F.col("y").alias("right"))
    inst_up = inherited.select(F.col("a").alias("left"), F.col("b").alias("x"))
    neg_inst = neg.where("relation = 'instance'").select("left", F.col("right").alias("v"))
    above = neg_inst.join(up.select(F.col("a").alias("y"), F.col("b").alias("v")), "v")
    hit_inst = above.join(inst_up, "left").select(F.lit("subclass").alias("relation"), F.col("x").alias("left"), F.col("y").alias("right"))
    hit_fact = above.select(F.lit("instance").alias("relation"), "left", F.col("y").alias("right"))
    no = hit_sub.unionByName(hit_inst).unionByName(hit_fact).distinct().withColumn("no", F.lit(True))
    q = q.join(no, ["relation", "left", "right"], "left").crossJoin(F.broadcast(broken))  # one row
    positive = F.when(F.col("relation").isNull() | F.col("kl").isNull() | F.col("kr").isNull(), "unknown").when(F.col("broken"), "inconsistent").when(F.col("yes"), "proven").when(F.col("no"), "disproven").otherwise("unknown")
    swapped = F.when(F.col("negative") & (positive == "proven"), "disproven").when(F.col("negative") & (positive == "disproven"), "proven").otherwise(positive)
    return q.select("id", swapped.alias("status"))


def facets(records: DataFrame) -> DataFrame:
    """(facet, key, ids): posting lists of records (record_id, relation, terms, section, page) in record order."""
    f = lambda n, c: records.select(F.lit(n).alias("facet"), c.cast("string").alias("key"), "record_id")
    rows = f("relation", F.col("relation")).unionByName(records.select(F.lit("term").alias("facet"), F.explode("terms").alias("key"), "record_id")).unionByName(f("section", F.col("section"))).unionByName(f("page", F.col("page")))
    return rows.where("key IS NOT NULL").distinct().groupBy("facet", "key").agg(F.array_sort(F.collect_list("record_id")).alias("ids"), F.count(F.lit(1)).alias("n"))


def retrieve(records: DataFrame, *, term=None, relation=None, section=None, page=None, text=None, limit: int | None = None) -> DataFrame:
    """Records under all facets given and with text in any field, in order; at most max(0, limit)."""
    out = records
    if term is not None:
        out = out.where(F.array_contains("terms", term))
    for name, value in (("relation", relation), ("section", section), ("page", page)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if text is not None:
        said = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kif", "cnl", "original", "section", "relation")], F.array_join("terms", "\n"))
        out = out.where(F.contains(F.lower(said), F.lit(text.lower())))
    out = out.orderBy("record_id")
    return out if limit is None else out.limit(max(0, limit))


#: Words that are no credible argument by themselves.
WEAK_ARGUMENTS = frozenset("""
on in at by to of for as or up out off into from with over under between through within without near above below
may can will shall must would could should might
dangerous likely unlikely key right left large larger largest small smaller smallest high higher highest low lower lowest
long short full main major minor most least best worst first last next great greater greatest new old
critical important significant effective current general primary secondary available possible necessary specific particular
various different common typical normal basic direct indirect rapid continuous simultaneous friendly hostile decisive
all each every any both such other many few several more less much
plan power time type kind part way point form role area case line state states level order place step phase stage side
range scope field base core unit end goal task result effect impact factor method system domain model class value
input output source target number size depth rate data fact risk cost loss gain term rule view mode means measure degree
force need act use move turn shift change run set human enemy surprise security
making planning processing training building running setting moving turning shifting
fog friction function action operation process report mission structure nature challenge reason aspect consideration
""".split())
#: Parents that a background edge does not license.
NOT_IMPLIED = ("MilitaryProcess", "Procedure")
_CLAIM = r"([A-Za-z][A-Za-z0-9_]*)\s+subclass-of\s+([A-Za-z][A-Za-z0-9_]*)"


def natural(text: Column) -> Column:
    """Lower words of letters and digits: names in Pascal case and underscores come apart, other signs become blanks."""
    apart = F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return X.squash(F.regexp_replace(F.lower(apart), r"[^a-z0-9\s]+", " "))


def or_plural(phrase: Column) -> Column:
    """A pattern for a natural phrase or its plural."""
    return (
        F.when(F.regexp_like(phrase, F.lit("[^aeiou]y$")), F.concat(F.regexp_replace(phrase, "y$", ""), F.lit("(?:y|ies)")))
        .when(F.regexp_like(phrase, F.lit("(s|x|z|ch|sh)$")), F.concat(phrase, F.lit("(?:es)?"))).otherwise(F.concat(phrase, F.lit("s?")))
    )


def _said(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])(?:"), pattern, F.lit(")(?![a-z0-9])")))


def gate(rows: DataFrame, *, aliases: dict[str, list[str]] | None = None, background: DataFrame | None = None) -> DataFrame:
    """rows (id, cnl, source, relations, classes) with pattern, reason (NULL: accepted; the first failing check) and ungrounded terms.

    aliases: further phrases of a class, a short written list. background: edges (child, parent) known beforehand; a lone
    subclass statement that is one of them needs a definition of its child in the source, but not the parent's name. Every
    subclass statement of a text is checked. A NULL source supports nothing.
    """
    src = natural(F.coalesce("source", F.lit("")))
    pattern = C.classify(F.col("cnl"))
    told = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in aliases.items() for x in kv]) if aliases else None
    phrases = lambda t: F.concat(F.array(natural(t)), F.coalesce(F.transform(F.try_element_at(told, t), natural), F.array().cast("array<string>"))) if aliases else F.array(natural(t))
    named = lambda t: F.exists(phrases(t), lambda p: _said(F.col("_src"), or_plural(p)))
    rows = rows.withColumns({"_src": src, "_pattern": pattern, "_claims": F.transform(F.regexp_extract_all("cnl", F.lit(_CLAIM), 0), lambda c: F.split(c, r"\s+subclass-of\s+"))})
    lone = F.regexp_extract("cnl", rf"^\s*{_CLAIM}\s*\.?\s*$", 1)
    rows = rows.withColumns({"_child": lone, "_parent": F.regexp_extract("cnl", rf"^\s*{_CLAIM}\s*\.?\s*$", 2)})
    if background is not None:
        known = background.where(~F.col("parent").isin(*NOT_IMPLIED)).select(F.col("child").alias("_child"), F.col("parent").alias("_parent"), F.lit(True).alias("_edge")).distinct()
        rows = rows.join(known, ["_child", "_parent"], "left")
    else:
        rows = rows.withColumn("_edge", F.lit(None).cast("boolean"))
    s = F.col("_src")
    like = lambda p: F.regexp_like(s, F.lit(p))
    copular, listing = like(r"\b(?:is|are|was|were)\s+(?:an?|the|some)\b"), like(r"\b(?:consists?\s+of|comprises?)\b")
    implied = F.coalesce("_edge", F.lit(False)) & like(r"\b(?:is|are|was|were)\s+(?:(?:an?|the)\s+|intelligence\b)") & named(F.col("_child"))
    rows = rows.withColumn("_implied", implied)
    implied = F.col("_implied")
    there = lambda p: F.regexp_like(s, F.concat(F.lit(r"\bthere (?:is|are|exists?)\b.*\b"), p, F.lit(r"\b|\b(?:at least one|some(?: entity is(?: an?| the)?)?|an? instance of) "), p, F.lit(r"\b|\b(?:an?|the) "), p, F.lit(r" exists?\b")))
    exists = like(r"\b(?:some|there\s+is|there\s+are|exists|exist)\b") & F.exists("classes", lambda t: F.exists(phrases(t), there))
    weak = F.exists("classes", lambda t: F.when(F.contains(natural(t), F.lit(" ")), F.exists(F.split(natural(t), " "), lambda w: w.isin(*WEAK_ARGUMENTS) & F.array_contains("relations", w))).otherwise(natural(t).isin(*WEAK_ARGUMENTS)))
    bad_rel = F.filter("relations", lambda t: ~_said(s, natural(t)))
    bad_class = F.filter("classes", lambda t: ~(implied & (t == F.col("_parent"))) & ~named(t))

    def stated(claim: Column) -> Column:
        """The source says that the claim's child is its parent, by a copula or by listing the parent's members."""
        child, parent = phrases(F.element_at(claim, 1)), phrases(F.element_at(claim, 2))
        head = lambda p: F.concat(F.lit(r"^(?:(?:a|an|the) )?"), p, F.lit(r" (?:is|are) "))
        tail = lambda p: F.concat(F.lit(r"(?:(?:a|an|the) )?(?:(?:type|kind|form) of )?"), p, F.lit("(?![a-z0-9])"))
        copula = F.exists(child, lambda c: (implied & F.regexp_like(s, head(c))) | F.exists(parent, lambda p: F.regexp_like(s, F.concat(head(c), tail(p)))))
        members = lambda p, c: F.regexp_like(s, F.concat(F.lit(r"^(?:(?:a|an|the) )?"), or_plural(p), F.lit(r" (?:consists? of|comprises?) (?:.*(?<![a-z0-9]))?(?:"), or_plural(c), F.lit(")(?![a-z0-9])")))
        return copula | F.exists(parent, lambda p: F.exists(child, lambda c: members(p, c)))

    n_c, n_r, p, claims = F.size("classes"), F.size("relations"), F.col("_pattern"), F.col("_claims")
    reason = (
        F.when((p == "subclass") & F.exists(claims, lambda c: F.element_at(c, 1) == F.element_at(c, 2)), "degenerate_form")
        .when((p == "subclass") & ((n_c < 2) | ~(copular | listing | implied)), "weak_grounding")
        .when((p == "instance") & ((n_c < 1) | ~copular), "weak_grounding")
        .when((p == "existential") & ((n_c < 1) | ~exists), "weak_grounding")
        .when((p == "relation") & (n_r > 0) & (n_c == 0), "degenerate_form")
        .when((p == "relation") & weak, "weak_argument")
        .when((p == "nary") & (n_r > 0) & (n_c < 3), "degenerate_form")
        .when(F.size("_bad_rel") > 0, "ungrounded_relation").when(F.size("_bad_class") > 0, "ungrounded_class_terms").when(X.scoped(F.coalesce("source", F.lit(""))), "unverified_scope")
        .when((F.size(claims) > 0) & (F.regexp_like(F.trim("cnl"), F.lit("^not ")) | ~F.forall(claims, stated)), "unverified_subclass_direction")
    )
    rows = rows.withColumns({"_bad_rel": bad_rel, "_bad_class": bad_class})
    rows = rows.withColumns({"pattern": p, "reason": reason, "ungrounded": F.array_distinct(F.concat("_bad_rel", "_bad_class"))})
    return rows.drop("_src", "_pattern", "_claims", "_child", "_parent", "_edge", "_implied", "_bad_rel", "_bad_class")


def evaluation(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of scored results (scored, route, expected, exact, restated); a ratio over nothing is NULL."""
    s, acc = F.col("scored"), F.col("scored") & (F.col("route") == "accepted")
    pos, neg = s & F.col("expected"), s & ~F.col("expected")
    n = lambda c: F.count_if(c)
    ratio = lambda a, b: F.try_divide(n(a).cast("double"), F.nullif(n(b), F.lit(0)))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), n(s).alias("scored"), n(acc).alias("accepted"), n(acc & F.col("exact")).alias("accepted_exact"), ratio(acc & F.col("exact"), acc).alias("precision"), ratio(acc, s).alias("coverage"),
        ratio(acc & F.col("exact"), pos).alias("positive_coverage"), ratio(neg & (F.col("route") == "abstain"), neg).alias("abstention_accuracy"), n(neg & (F.col("route") == "accepted")).alias("false_accepts"),
        n(acc & ~F.col("restated")).alias("novel"), ratio(acc & ~F.col("restated"), s).alias("novel_coverage"), n(F.col("route") == "review").alias("review"))


def proofs(facts: DataFrame, atoms: DataFrame) -> DataFrame:
    """(id, records) of atoms (id, relation, left, right) that follow from the positive facts (record_id, relation, left, right, negative): the sorted ids of the facts of one shortest proof; of equal facts the smallest id. An atom that does not follow has no row."""
    pos = facts.where("NOT negative")
    sub = pos.where("relation = 'subclass'").groupBy(F.col("left").alias("a"), F.col("right").alias("b")).agg(F.min("record_id").alias("record_id"))
    up = closure(sub).select("a", "b", "hops", "path")
    inst = pos.where("relation = 'instance'").groupBy(F.col("left").alias("i"), F.col("right").alias("a")).agg(F.min("record_id").alias("first"))
    classes = atoms.where("relation = 'subclass'").join(up.withColumnsRenamed({"a": "left", "b": "right"}), ["left", "right"]).select("id", "path", F.lit(None).cast(facts.schema["record_id"].dataType).alias("first"))
    asked = atoms.where("relation = 'instance'").join(inst.withColumnRenamed("i", "left"), "left")
    reached = asked.join(up, "a", "left").where("a = right OR b = right")
    ways = reached.select("id", F.when(F.col("a") == F.col("right"), F.array("a")).otherwise(F.col("path")).alias("path"), "first")
    member = ways.groupBy("id").agg(F.min_by(F.struct("path", "first"), F.struct(F.size("path"), "first")).alias("w")).select("id", "w.path", "w.first")
    found = cut(classes.unionByName(member))
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.element_at("path", k).alias("a"), F.element_at("path", k + 1).alias("b")))
    used = found.where(F.size("path") > 1).select("id", F.inline(steps)).join(sub, ["a", "b"]).select("id", "record_id").unionByName(found.where("first IS NOT NULL").select("id", F.col("first").alias("record_id")))
    return used.groupBy("id").agg(F.array_sort(F.collect_set("record_id")).alias("records"))


def bundle_status(records: DataFrame) -> DataFrame:
    """One row, status, of a bundle (record_id, kif): 'unsupported' if a formula is no ground classification, 'unsatisfiable' if the facts contradict each other, else 'satisfiable', which alone is valid."""
    parsed = records.select("record_id", *[c.alias(k) for k, c in C.ground_literal(F.col("kif")).items()])
    if not parsed.where("relation IS NULL").isEmpty():
        return records.sparkSession.createDataFrame([("unsupported",)], "status string")
    probe = parsed.limit(1).select(F.lit(1).alias("id"), "relation", "left", "right", "negative")  # any known term tells
    told = answers(parsed.drop("record_id"), probe).select(F.when(F.col("status") == "inconsistent", "unsatisfiable").otherwise("satisfiable").alias("status"))
    return told.agg(F.coalesce(F.first("status"), F.lit("satisfiable")).alias("status"))
