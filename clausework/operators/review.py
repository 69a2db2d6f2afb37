"""Review, diagnosis and scoring of claims: annotation exports, buckets, audits of targets, score tables, stratified selection, memories and sense glosses.

Joins are on ids, keys or claim pairs; counts are partial aggregations. Nothing here gathers a group in a task, but for
lists that are short by what they hold (the modes of a claim).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import audit as A

#: Enumerations of a review, buckets of a diagnosis, verdicts of a triage, tags in the order of selection.
REVIEWERS = ("human", "ai", "unspecified")
PATTERNS = ("subclass", "instance", "relation", "binary", "nary", "existential", "conditional", "negation")
BUCKETS = ("correct", "wrong_kif", "wrong_cnl", "grounding_rejected", "compile_failed", "abstained", "review_only", "error")
VERDICTS = ("expressible", "partial", "blocked")
TAGS = ("negation", "condition", "modality", "definition", "relation", "other")
NO_GLOSS = "No ontology definition available."
_PAIR = r"\(subclass\s+(\S+)\s+([^\s)]+)\s*\)"


def _text(name: str) -> Column:
    """A cell without outer blanks; NULL for an empty one."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


# ---------------------------------------------------------------- reviewed annotations


def annotation_violations(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(record_id, rule) for annotations that must not be exported.

    annotations: record_id, nl, status, reviewed_by, reviewer_type, formalizable, cnl, pattern, review_seconds (all as
    written) and compiled (what cnl compiles to; NULL: it does not). candidates: record_id, nl. Ids are checked for every
    annotation, the rest for reviewed ones only. A repeated candidate id is a fault of the candidates, told as such.
    """
    known = candidates.groupBy("record_id").agg(F.min("nl").alias("_nl"), F.count(F.lit(1)).alias("_nc"))
    rows = annotations.join(known, "record_id", "left").join(A.duplicates(annotations, "record_id"), "record_id", "left")
    reviewed = F.col("status").eqNullSafe(F.lit("reviewed"))
    label, seconds = F.lower(_text("formalizable")), F.col("review_seconds").try_cast("double")
    kind = F.coalesce(F.lower(_text("reviewer_type")), F.lit("unspecified"))
    yes, no = reviewed & label.eqNullSafe(F.lit("true")), reviewed & label.eqNullSafe(F.lit("false"))
    given = F.coalesce(F.col("review_seconds"), F.lit("")) != ""
    return A.violations(rows, "record_id", {
        "unknown id": F.col("_nc").isNull(), "repeated id": F.col("n").isNotNull(), "repeated candidate": F.col("_nc") > 1,
        "source changed": reviewed & F.col("_nc").isNotNull() & ~F.col("nl").eqNullSafe(F.col("_nl")), "no reviewer": reviewed & _text("reviewed_by").isNull(), "reviewer type": reviewed & ~kind.isin(*REVIEWERS), "label": reviewed & ~yes & ~no,
        "positive without form": yes & (_text("cnl").isNull() | ~F.coalesce(_text("pattern").isin(*PATTERNS), F.lit(False))), "does not compile": yes & _text("cnl").isNotNull() & F.col("compiled").isNull(),
        "abstention asserts": no & (_text("cnl").isNotNull() | _text("pattern").isNotNull()), "duration": reviewed & given & ~F.coalesce((seconds >= 0) & (seconds < float("inf")), F.lit(False)),
    }).distinct()


def reviewed_export(annotations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reviewed annotations on the candidate they belong to, with typed cells; rows with a violation are left out (read annotation_violations beside it)."""
    bad = annotation_violations(annotations, candidates).select("record_id").distinct()
    label = F.lower(_text("formalizable")) == "true"
    cells = annotations.where("status = 'reviewed'").join(bad, "record_id", "left_anti").select(
        "record_id", label.alias("formalizable"), _text("cnl").alias("cnl"), F.when(label, F.col("compiled")).alias("kif"), _text("pattern").alias("pattern"), F.lit("reviewed").alias("status"), F.lit("eval").alias("split"),
        F.trim("reviewed_by").alias("reviewed_by"), F.coalesce(F.lower(_text("reviewer_type")), F.lit("unspecified")).alias("reviewer_type"), F.nullif("review_seconds", F.lit("")).try_cast("double").alias("review_seconds"))
    return candidates.select("record_id", "nl").join(cells, "record_id")


# ---------------------------------------------------------------- joins


def restates(rows: DataFrame, asserted: DataFrame, *, key: str = "record_id") -> DataFrame:
    """(key, restates): whether every subclass claim of kif is an asserted pair (child, parent); false for a row without a claim."""
    claims = rows.select(key, F.explode_outer(F.array_distinct(F.regexp_extract_all("kif", F.lit(_PAIR), 0))).alias("_c"))
    claims = claims.select(key, F.regexp_extract("_c", _PAIR, 1).alias("child"), F.regexp_extract("_c", _PAIR, 2).alias("parent"))
    hit = claims.join(asserted.select("child", "parent", F.lit(True).alias("_hit")).distinct(), ["child", "parent"], "left")
    return hit.groupBy(key).agg(F.bool_and(F.coalesce("_hit", F.lit(False))).alias("restates"))


def first_of_doc(doc: Column) -> Column:
    """The first sentence of a documentation text without its markup, ended by a stop or a semicolon before a blank."""
    return F.split(X.squash(F.replace(F.replace(doc, F.lit("&%"), F.lit("")), F.lit(";;"), F.lit(""))), r"(?<=[.;])\s", 2)[0]


def glosses(*sources: DataFrame) -> DataFrame:
    """(term, gloss) of sources (term, doc, seq): a later source wins over an earlier one, and within one the last row by seq; blank docs say nothing."""
    ranked = [s.where("doc <> ''").select("term", "doc", F.lit(k).alias("_k"), F.col("seq").cast("long").alias("_s")) for k, s in enumerate(sources)]
    got = A.union_all(ranked).groupBy("term").agg(F.max_by("doc", F.struct("_k", "_s")).alias("doc"))
    return got.select("term", first_of_doc(F.col("doc")).alias("gloss"))


def with_gloss(rows: DataFrame, gloss: DataFrame, *, term: str = "parent") -> DataFrame:
    """rows with gloss: that of their term, or the default."""
    g = gloss.select(F.col("term").alias(term), F.col("gloss").alias("_g"))
    return rows.join(g, term, "left").withColumn("gloss", F.coalesce("_g", F.lit(NO_GLOSS))).drop("_g")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides hold; must be empty for held-out data."""
    return a.select(key).intersect(b.select(key))


def claims_by_key(scored: DataFrame, order: str) -> DataFrame:
    """Accepted claims (run, record_id, kif) once, with evidence of the first row by `order` and the modes that gave them, in order. NULL is not accepted."""
    modes = F.transform(F.array_sort(F.collect_list(F.struct(order, "mode"))), lambda x: x["mode"])
    return scored.where("accepted").groupBy("run", "record_id", "kif").agg(F.min_by("evidence", order).alias("evidence"), modes.alias("modes"))


def unseen(rows: DataFrame, known: list[DataFrame], *, text: str = "nl") -> DataFrame:
    """rows with seen: whether their text, squashed and lower, is one of the texts of any of the known frames."""
    keys = A.union_all([k.select(X.text_key(F.col(text)).alias("_k")) for k in known]).where("_k <> ''").distinct().withColumn("seen", F.lit(True))
    return rows.withColumn("_k", X.text_key(F.col(text))).join(keys, "_k", "left").withColumn("seen", F.coalesce("seen", F.lit(False))).drop("_k")


def declaration_matches(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """candidates (id, text, evidence) with the symbol of the one registry entry (alias, evidence_cue, symbol) whose alias opens the text, after an article or none, and whose cue the evidence holds; n_matches over 1 is a fault and gives no symbol.

    Texts meet aliases in an equi join: their openings of 1 to as many words as the longest alias has.
    """
    entries = registry.select(X.text_key(F.col("alias")).alias("_a"), X.text_key(F.col("evidence_cue")).alias("_cue"), "symbol")
    longest = entries.agg(F.max(X.n_squashed(F.col("_a"))).alias("n")).first()["n"] or 0
    words = F.split(F.regexp_replace(X.text_key(F.col("text")), r"^(a|an|the)\s+", ""), " ")
    openings = F.transform(F.sequence(F.lit(1), F.least(F.size("_w"), F.lit(longest))), lambda n: F.array_join(F.slice("_w", 1, n), " "))
    opened = candidates.select("id", X.text_key(F.col("evidence")).alias("_e"), words.alias("_w")).where(F.lit(longest > 0)).select("id", "_e", F.explode(openings).alias("_a"))
    hits = opened.join(entries, "_a").where(F.contains("_e", "_cue")).groupBy("id").agg(F.count(F.lit(1)).alias("n_matches"), F.min("symbol").alias("symbol"))
    out = candidates.join(hits, "id", "left")
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)).cast("long")).withColumn("symbol", F.when(F.col("n_matches") == 1, F.col("symbol")))


# ---------------------------------------------------------------- counts


def bucket() -> Column:
    """The bucket of a diagnosed row: split, status, formalizable, from_review, cnl, kif (gold), predicted, compiled, grounded, error."""
    c, nothing = F.col, F.col("predicted").isNull()
    formal = F.coalesce(c("formalizable"), F.lit(True))
    same = lambda a, b: F.trim(c(a)) == F.trim(F.coalesce(c(b), F.lit("")))
    no_model = c("error").eqNullSafe(F.lit("no_model"))
    apart = c("split").eqNullSafe(F.lit("abstain")) | (c("status").eqNullSafe(F.lit("reviewed")) & ~formal)
    failed = F.coalesce((c("error") != "") & ~F.startswith("error", F.lit("compile:")), F.lit(False))
    return (
        F.when(apart, F.when(nothing & c("error").isNull(), "correct").when(nothing & no_model, "abstained").otherwise("wrong_cnl"))
        .when(c("from_review"), "review_only").when(failed, F.when(no_model, "abstained").otherwise("error")).when(nothing, F.when(formal, "abstained").otherwise("correct"))
        .when(c("compiled").isNull(), "compile_failed").when(c("grounded").eqNullSafe(F.lit(False)), "grounding_rejected")
        .when(same("predicted", "cnl"), F.when(same("compiled", "kif"), "correct").otherwise("wrong_kif")).otherwise("wrong_cnl")
    )


def with_zeros(rows: DataFrame, column: str, domain: tuple[str, ...] | DataFrame) -> DataFrame:
    """(column, n): how many rows hold each value of the domain, zeros too."""
    spark = rows.sparkSession
    all_of = spark.createDataFrame([(v,) for v in domain], f"{column} string") if isinstance(domain, tuple) else domain.select(column).distinct()
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_of.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def diagnosis(bucketed: DataFrame) -> DataFrame:
    """One row: total, scored (all but review only), correct ones of both kinds and the accuracy in percent (NULL if nothing is scored)."""
    formal, right = F.coalesce("formalizable", F.lit(True)), F.col("bucket") == "correct"
    scored = F.count_if(F.col("bucket") != "review_only")
    return bucketed.agg(F.count(F.lit(1)).alias("total"), scored.alias("scored"), F.count_if(right & formal).alias("correct_positive"), F.count_if(right & ~formal).alias("correct_abstain"), F.try_divide(F.count_if(right) * F.lit(100.0), scored).alias("accuracy"))


def target_audit(rows: DataFrame) -> DataFrame:
    """(pattern, kind, n, line, cnl) of compiled targets (line, pattern, cnl, kif, compiled, kind): valid ones, faults by kind, and valid ones with another formula, each with its first example. A row without a pattern is 'unknown'."""
    kinds = F.array_compact(F.array(F.when(F.col("kind") == "valid", "valid_closed_cnl").otherwise(F.col("kind")), F.when((F.col("kind") == "valid") & ~F.col("kif").eqNullSafe(F.col("compiled")), "kif_mismatch")))
    said = rows.select(F.coalesce(F.nullif("pattern", F.lit("")), F.lit("unknown")).alias("pattern"), "line", "cnl", F.explode(kinds).alias("kind"))
    return said.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"), F.min_by("cnl", "line").alias("cnl"))


def validation_counts(rows: DataFrame) -> DataFrame:
    """Counts by pattern and over all (pattern NULL) of rows (pattern, cnl, generated, expected_kif, generated_kif; a kif is NULL if its text does not compile), with the share of exact formulas among valid targets."""
    target, exact = F.col("expected_kif").isNotNull(), F.col("cnl").eqNullSafe(F.col("generated"))
    same = target & F.col("expected_kif").eqNullSafe(F.col("generated_kif"))
    rows = rows.withColumn("pattern", F.coalesce(F.nullif("pattern", F.lit("")), F.lit("unknown")))
    return rows.rollup("pattern").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(target).alias("expected_valid_cnl"), F.count_if(~target).alias("expected_invalid_cnl"), F.count_if(same).alias("exact_kif_on_valid_targets"), F.count_if(~target & exact).alias("copied_invalid_target"),
        F.count_if(F.col("generated_kif").isNotNull()).alias("valid_cnl"), F.count_if(exact).alias("exact_cnl"), F.try_divide(F.count_if(same), F.count_if(target)).alias("exact_share"))


def declaration_scores(scored: DataFrame) -> DataFrame:
    """One row a mode of scored (mode, route, exact, grounded, declared, reason, saved): what each gate accepted, and how much of that is the labelled formula or another one."""
    on = lambda n: F.col(n).eqNullSafe(F.lit(True))
    return scored.groupBy("mode").agg(
        F.count_if("exact").alias("exact"), F.count_if(F.col("route") == "valid_cnl_other_formula").alias("compiled_other"), F.count_if(on("grounded")).alias("grounder_accepted"), F.count_if(on("declared")).alias("declared_accepted"),
        F.count_if(on("declared") & on("exact")).alias("declared_exact"), F.count_if(on("declared") & ~on("exact")).alias("declared_other"), F.count_if(on("saved")).alias("saved_accepted"), F.count_if(on("saved") & ~on("exact")).alias("saved_other"))


def score_histograms(scored: DataFrame) -> DataFrame:
    """(mode, of, value, n): routes of each mode, and reasons of the rows that met the declared gate ('accepted' where it gave none)."""
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("accepted"))
    pairs = F.array(F.struct(F.lit("route").alias("of"), F.col("route").alias("value")), F.struct(F.lit("reason").alias("of"), F.when(F.col("declared").isNotNull(), reason).alias("value")))
    return scored.select("mode", F.inline(pairs)).where("value IS NOT NULL").groupBy("mode", "of", "value").agg(F.count(F.lit(1)).alias("n"))


def triage(rows: DataFrame) -> DataFrame:
    """(of, value, n) of rows (verdict, blockers as a comma list): all verdicts with zeros, expressible ones with and without META, blockers of all rows and of blocked ones."""
    some = rows.select("verdict", F.explode(F.filter(F.split("blockers", ","), lambda b: b != "")).alias("value"))
    count = lambda df, of: df.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(of).alias("of"), "value", "n")
    meta = F.coalesce(F.contains("blockers", F.lit("META")), F.lit(False))
    kinds = rows.where("verdict = 'expressible'").select(F.when(meta, "bibliographic").otherwise("substantive").alias("verdict"))
    counted = [with_zeros(rows, "verdict", VERDICTS).select(F.lit("verdict").alias("of"), F.col("verdict").alias("value"), "n"), with_zeros(kinds, "verdict", ("bibliographic", "substantive")).select(F.lit("expressible").alias("of"), F.col("verdict").alias("value"), "n")]
    return A.union_all([*counted, count(some, "blockers_all"), count(some.where("verdict = 'blocked'"), "blockers_blocked")])


def prepared_counts(generated: DataFrame, written: DataFrame, focused: Column) -> DataFrame:
    """(pattern, generated, written, focused): rows of each pattern before and after preparation, and how many of the written ones are in focus."""
    a = generated.groupBy("pattern").agg(F.count(F.lit(1)).alias("generated"))
    b = written.groupBy("pattern").agg(F.count(F.lit(1)).alias("written"), F.count_if(focused).alias("focused"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return a.join(b, "pattern", "full").select("pattern", zero("generated"), zero("written"), zero("focused"))


def study_preflight(records: DataFrame, *, training_given: bool) -> DataFrame:
    """One row of counts and blockers before a study of records (status, split, overlaps, reviewer_type, formalizable, restates, scope_error)."""
    c = F.col
    reviewed = c("status").isin("reviewed", "accepted") & ~c("split").eqNullSafe(F.lit("train"))
    eligible = reviewed & ~c("overlaps")
    positive = eligible & c("formalizable")
    facts = records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(reviewed).alias("reviewed_test"), F.count_if(eligible).alias("eligible"), F.count_if(positive).alias("positive"), F.count_if(positive & ~c("restates")).alias("novel"),
        F.count_if(eligible & c("reviewer_type").eqNullSafe(F.lit("ai"))).alias("ai_reviewed"), F.count_if("overlaps").alias("overlapping"), F.count_if(eligible & ~c("formalizable")).alias("abstentions"), F.count_if(positive & c("scope_error")).alias("scope_errors"))
    blockers = {"no training files": F.lit(not training_given), "training overlap": c("overlapping") > 0, "labels of a machine": c("ai_reviewed") > 0, "no novel positive": c("novel") == 0, "no abstention": c("abstentions") == 0, "scope or kinds": c("scope_errors") > 0}
    got = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in blockers.items()]))
    return facts.withColumn("blockers", got).withColumn("status", F.when(F.size("blockers") > 0, "blocked").otherwise("data_checks_passed"))


# ---------------------------------------------------------------- selection


def stratified(rows: DataFrame, n: int, *, excluded: DataFrame | None = None, order: Column | None = None) -> DataFrame:
    """Up to n rows (record_id, nl, phenomena), one text once, taken in rounds: each tag in turn takes its first row that is not taken yet.

    Rows lie in hash order of their id (a stand-in for a random order). A tag takes at most one row a round, so only the
    first n rows of each tag can be taken: these, 6 n at most, are found by a window with a group limit and dealt out here;
    n is what the caller asks for. `excluded` (nl): texts that are not taken, by text key. n below one gives no rows.
    Text keys are grouped by 128 bits of hash and tags are bits of a number, so that groups are hashed and not sorted.
    """
    spark, n = rows.sparkSession, max(0, n)
    place = F.struct((F.xxhash64("record_id") if order is None else order).alias("h"), F.col("record_id"))
    hashes = [F.xxhash64("_k").alias("_a"), F.xxhash64(F.lit(1), "_k").alias("_b")]
    bits = sum((F.when(F.array_contains("phenomena", t), 1 << k).otherwise(0) for k, t in enumerate(TAGS)), F.lit(0))
    keyed = rows.select("record_id", bits.alias("_m"), X.text_key(F.col("nl")).alias("_k")).select("record_id", "_m", *hashes)
    once = keyed.groupBy("_a", "_b").agg(F.min_by("_m", "record_id").alias("_m"), F.min("record_id").alias("record_id"))
    if excluded is not None:
        once = once.join(excluded.where("nl IS NOT NULL").select(X.text_key(F.col("nl")).alias("_k")).select(*hashes).distinct(), ["_a", "_b"], "left_anti")
    held = F.array_compact(F.array(*[F.when(F.col("_m").bitwiseAND(1 << k) != 0, F.lit(t)) for k, t in enumerate(TAGS)]))
    tagged = once.select("record_id", F.explode(held).alias("tag"), place.alias("_o"))
    first = tagged.withColumn("_n", F.row_number().over(W.partitionBy("tag").orderBy("_o"))).where(F.col("_n") <= n)
    lists: dict[str, list] = {t: [] for t in TAGS}
    for r in first.select("tag", "record_id", "_n").orderBy("tag", "_n").collect():  # 6 n rows at most
        lists[r.tag].append(r.record_id)
    taken: dict = {}
    while len(taken) < n:
        before = len(taken)
        for tag in TAGS:
            free = next((i for i in lists[tag] if i not in taken), None)
            if free is not None and len(taken) < n:
                taken[free] = tag
        if len(taken) == before:
            break
    kind = rows.schema["record_id"].dataType.simpleString()
    picked = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(taken.items())], f"record_id {kind}, picked_as string, pick int")
    return rows.join(F.broadcast(picked), "record_id")  # n rows


# ---------------------------------------------------------------- memories and frozen inputs


def ontology_memory(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(statement_id, child, parent, line, unknown) of lines that are one subclass statement and nothing else; unknown names a term outside the vocabulary, which is a fault."""
    p = r"^\s*\(subclass\s+([A-Za-z][A-Za-z0-9_]*)\s+([A-Za-z][A-Za-z0-9_]*)\s*\)\s*$"
    got = lines.select("line", F.regexp_extract("text", p, 1).alias("child"), F.regexp_extract("text", p, 2).alias("parent")).where("child <> ''")
    for side in ("child", "parent"):
        got = got.join(classes.select(F.col("term").alias(side), F.lit(True).alias(f"_{side}")).distinct(), side, "left")
    unknown = F.when(F.col("_child").isNull(), F.col("child")).when(F.col("_parent").isNull(), F.col("parent"))
    return got.select(F.concat(F.lit("memory:"), F.col("line").cast("string")).alias("statement_id"), "child", "parent", "line", unknown.alias("unknown"))


def prior_claims(scored: DataFrame, *, mode: str = "rules") -> DataFrame:
    """(statement_id, child, parent, line, fault) of an earlier run's rows (line, record_id, mode, accepted, kif) that its gate accepted in that mode; a row that is no plain subclass statement is a fault."""
    p = r"^\(subclass ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)$"
    rows = scored.where((F.col("mode") == mode) & F.col("accepted").eqNullSafe(F.lit(True)))
    part = lambda k: F.nullif(F.regexp_extract("kif", p, k), F.lit(""))
    return rows.select(F.concat(F.lit("prior-claim:"), F.col("record_id").cast("string")).alias("statement_id"), part(1).alias("child"), part(2).alias("parent"), "line", F.when(part(1).isNull(), "no subclass claim").alias("fault"))


def frozen_violations(rows: DataFrame, *, sha256: str | None, expected_sha256: str, expected_count: int, labels: tuple[str, ...] = ("decision", "cnl", "kif")) -> list[str]:
    """What breaks the promise that inputs are frozen and unlabelled: another hash, another count, repeated ids, label columns."""
    n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("record_id")).first()
    told = {"sources changed": sha256 != expected_sha256, "count changed": n != expected_count, "repeated ids": distinct != n, "labels": bool(set(labels) & set(rows.columns))}
    return [k for k, broken in told.items() if broken]


def overlap_sets(files: list[DataFrame]) -> DataFrame:
    """(kind, text): distinct sentences and controlled statements of benchmark files (nl, cnl), blank ones aside."""
    both = [f.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("nl", "cnl")]))) for f in files]
    return reduce(DataFrame.unionByName, both).where("text <> ''").distinct()


# ---------------------------------------------------------------- vocabulary


def documented_classes(docs: DataFrame, classes: DataFrame, relations: DataFrame) -> DataFrame:
    """term and whether it was only documented: classes, and documented terms in capitals that are neither class nor relation."""
    more = docs.select("term").distinct().where(F.regexp_like("term", F.lit(r"^\p{Lu}"))).join(relations.select("term"), "term", "left_anti").join(classes.select("term"), "term", "left_anti")
    return classes.select("term", F.lit(False).alias("fallback")).distinct().unionByName(more.select("term", F.lit(True).alias("fallback")))


def alternation(terms: DataFrame, *, form: str = "regex") -> DataFrame:
    """One row, text: the closed alternation of a vocabulary (term), longest first and then in order, as a pattern or as quoted literals. A vocabulary is one string here, as a grammar needs it."""
    short_last = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    listed = F.array_sort(F.collect_set("term"), short_last)
    if form == "regex":
        return terms.agg(F.array_join(F.transform(listed, lambda t: F.regexp_replace(t, r"([^A-Za-z0-9_])", r"\\$1")), "|").alias("text"))
    quoted = lambda t: F.concat(F.lit('"'), F.regexp_replace(t, r'(["\\])', r"\\$1"), F.lit('"'))
    return terms.agg(F.array_join(F.transform(listed, quoted), " | ").alias("text"))


def grammar(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """(seq, rule): a grammar of one canonical statement over a closed vocabulary, a rule a row."""
    fixed = [
        (0, 'root ::= unary | subclass | relation | negation | quantified | conditional'), (1, 'unary ::= variable " is-a " class'), (2, 'subclass ::= class " subclass-of " class'), (3, 'relation ::= rel " " term " " term | rel " [ " term (" , " term)+ " ]"'),
        (4, 'negation ::= "not " (unary | subclass | relation)'), (5, 'quantified ::= ("some " | "no ") unary | ("every " | "no ") unary " implies " (unary | relation)'), (6, 'conditional ::= "if " (unary | relation) " and " (unary | relation) " then " (unary | relation)'), (7, 'term ::= variable | class'), (8, 'variable ::= "?" [a-z] [a-z0-9]*'),
    ]
    named = lambda k, name, terms: alternation(terms, form="literal").select(F.lit(k).alias("seq"), F.concat(F.lit(f"{name} ::= "), "text").alias("rule"))
    return A.union_all([classes.sparkSession.createDataFrame(fixed, "seq int, rule string"), named(9, "class", classes), named(10, "rel", relations)])
