"""Queries of review, diagnosis and scoring over the driver's tables, whose rows are dressed as annotations, runs and claims by rules that the SQL states anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cnl as C
from ..functions import text as X
from ..operators import knowledge as K
from ..operators import review as R
from ..operators import segment as S
from . import fixtures as FX
from .registry import query, table
from .sql import squash

c = F.col


def _key(name: str, by: int):
    return c(name) % by


def _reviewed(spark, d):
    """Candidates (documents) and annotations of them (labels) with faults of each kind."""
    docs = table(spark, d, "documents").select(c("doc_id").alias("record_id"), c("text").alias("nl"))
    i = c("record_id")
    rows = table(spark, d, "labels").withColumnRenamed("doc_id", "record_id").join(docs, "record_id", "left").select(
        "record_id", F.when(i % 11 == 0, F.concat("nl", F.lit("x"))).otherwise(c("nl")).alias("nl"), F.when(i % 10 == 9, "draft").otherwise("reviewed").alias("status"), F.when(i % 13 == 0, " ").otherwise("r1").alias("reviewed_by"),
        F.when(i % 17 == 0, "robot").when(i % 17 == 1, "").otherwise(" AI ").alias("reviewer_type"), F.when(i % 19 == 0, "maybe").when(c("quality") == 1, "True").otherwise("false").alias("formalizable"),
        F.when(i % 7 == 0, "Ferry subclass-of Moon").when(i % 2 == 0, "Ferry subclass-of Vessel").alias("cnl"), F.when((i % 7 == 0) | (i % 2 == 0), "subclass").alias("pattern"), F.when(i % 23 == 0, "-1").when(i % 29 == 0, "x").when(i % 3 == 0, "").otherwise("12.5").alias("review_seconds"))
    done = C.compile_cnl(rows, FX.frame(spark, FX.CLASSES, "seq int, term string"), FX.frame(spark, FX.RELATIONS, "term string, arity int"))
    return done.withColumnRenamed("kif", "compiled").drop("error"), docs


ANNOTATED = """(SELECT doc_id AS id, doc_id % 10 <> 9 AS rev, quality = 1 AND doc_id % 19 <> 0 AS yes, quality <> 1 AND doc_id % 19 <> 0 AS no, doc_id % 7 = 0 AS wrong, doc_id % 7 = 0 OR doc_id % 2 = 0 AS formed, d.doc_id IS NULL AS lost
FROM labels LEFT JOIN (SELECT doc_id FROM documents) d USING (doc_id))"""
BROKEN = f"""(SELECT id AS record_id, unnest(list_filter([CASE WHEN lost THEN 'unknown id' END, CASE WHEN rev AND NOT lost AND id % 11 = 0 THEN 'source changed' END, CASE WHEN rev AND id % 13 = 0 THEN 'no reviewer' END, CASE WHEN rev AND id % 17 = 0 THEN 'reviewer type' END,
CASE WHEN rev AND id % 19 = 0 THEN 'label' END, CASE WHEN rev AND yes AND NOT formed THEN 'positive without form' END, CASE WHEN rev AND yes AND wrong THEN 'does not compile' END, CASE WHEN rev AND no AND formed THEN 'abstention asserts' END,
CASE WHEN rev AND (id % 23 = 0 OR id % 29 = 0) THEN 'duration' END], lambda x: x IS NOT NULL)) AS rule FROM {ANNOTATED})"""


@query(f"SELECT record_id, rule FROM {BROKEN}")
def val_review(spark, d):
    """VAL-06, JON-01: faults of each kind in a review of all labelled documents"""
    return R.annotation_violations(*_reviewed(spark, d))


@query(f"""SELECT id AS record_id, yes AS formalizable, CASE WHEN yes THEN '(subclass Ferry Vessel)' END AS kif, CASE WHEN id % 17 = 1 THEN 'unspecified' ELSE 'ai' END AS reviewer_type, CASE WHEN id % 3 <> 0 THEN 12.5::DOUBLE END AS review_seconds
FROM {ANNOTATED} WHERE rev AND id NOT IN (SELECT record_id FROM {BROKEN})""")
def snk_reviewed(spark, d):
    """JON-01, VAL-06: what is exported of that review"""
    return R.reviewed_export(*_reviewed(spark, d)).select("record_id", "formalizable", "kif", "reviewer_type", "review_seconds")


@query("SELECT p_partkey AS record_id, p_size % 3 <> 0 AND p_partkey % 2 = 0 AND p_size < 25 AS restates FROM part")
def jon_restates(spark, d):
    """JON-07: every claim must be asserted; a row without a claim restates nothing"""
    p = table(spark, d, "part").select(c("p_partkey").alias("record_id"), "p_size", F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("a"), F.concat(F.lit("T"), "p_type").alias("b"), F.concat(F.lit("S"), c("p_size").cast("string")).alias("s"))
    kif = F.when(c("p_size") % 3 != 0, F.concat(F.lit("(and (subclass "), "a", F.lit(" "), "b", F.lit(") (subclass  "), "b", F.lit(" "), "s", F.lit(" ))"))).otherwise(F.concat(F.lit("(instance "), "a", F.lit(" Part)")))
    known = p.where("record_id % 2 = 0").select(c("a").alias("child"), c("b").alias("parent")).union(p.where("p_size < 25").select("b", "s"))
    return R.restates(p.select("record_id", kif.alias("kif")), known)


@query("""WITH g AS (SELECT p_name, arg_max('The ' || p_brand || ' kind;', p_partkey) AS one, arg_max('Big ' || p_brand || '.', p_partkey) FILTER (p_size > 45) AS two FROM part GROUP BY p_name)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'No ontology definition available.' ELSE coalesce(two, one) END AS gloss FROM part JOIN g USING (p_name)""")
def jon_gloss(spark, d):
    """SRC-19, JON-16: records' docs, statements that win over them, and a default"""
    p = table(spark, d, "part")
    said = lambda rows, *parts: rows.select(c("p_name").alias("term"), F.concat(*parts).alias("doc"), c("p_partkey").alias("seq"))
    got = R.glosses(said(p, F.lit("The  &%"), "p_brand", F.lit(" kind; and\nmore. End.")), said(p.where("p_size > 45"), F.lit("Big "), "p_brand", F.lit(". Rest;;.")))
    rows = p.select("p_partkey", F.when(c("p_partkey") % 5 == 0, F.lit("none")).otherwise(c("p_name")).alias("parent"))
    return R.with_gloss(rows, got).select("p_partkey", "gloss")


@query("SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def jon_shared(spark, d):
    """JON-17: keys on both sides of a split"""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey")
    return R.shared_keys(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "custkey")


LINE_ORDER = "l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT"


@query(f"""SELECT l_returnflag AS run, l_orderkey AS record_id, l_linestatus AS kif, arg_min(l_partkey::VARCHAR, {LINE_ORDER}) AS evidence, string_agg(l_linenumber::VARCHAR, ',' ORDER BY {LINE_ORDER}) AS modes
FROM lineitem WHERE l_linenumber <> 3 AND l_quantity > 25 GROUP BY 1, 2, 3""")
def jon_claims(spark, d):
    """JON-19: claims once, with their modes; an unknown acceptance is none"""
    text = lambda n: c(n).cast("string")
    rows = table(spark, d, "lineitem").select(c("l_returnflag").alias("run"), c("l_orderkey").alias("record_id"), c("l_linestatus").alias("kif"), text("l_partkey").alias("evidence"), text("l_linenumber").alias("mode"),
        F.when(c("l_linenumber") != 3, c("l_quantity") > 25).alias("accepted"), F.concat_ws("-", text("l_linenumber"), text("l_partkey"), text("l_suppkey"), c("l_quantity").cast("int").cast("string")).alias("o"))
    return R.claims_by_key(rows, "o").withColumn("modes", F.array_join("modes", ","))


@query(f"WITH k AS (SELECT lower({squash('text')}) AS t FROM benchmark UNION SELECT lower({squash('text')}) FROM documents WHERE source = 'src3') SELECT lower({squash('text')}) IN (SELECT t FROM k WHERE t <> '') AS seen, count(*) AS n FROM documents WHERE text IS NOT NULL AND source <> 'src3' GROUP BY 1")
def jon_unseen(spark, d):
    """JON-20: documents of the other sources whose text is no benchmark text and no document of src3"""
    nl = lambda df: df.where("text IS NOT NULL").select(c("text").alias("nl"))
    docs = table(spark, d, "documents")
    got = R.unseen(nl(docs.where("source <> 'src3'")), [nl(table(spark, d, "benchmark")), nl(docs.where("source = 'src3'"))])
    return got.groupBy("seen").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT n_name AS alias, 'N' || n_nationkey AS symbol FROM nation UNION ALL SELECT lower(n_name), 'twice' FROM nation WHERE n_nationkey = 5)
SELECT c_custkey AS id, count(symbol) AS n_matches, CASE WHEN count(symbol) = 1 THEN min(symbol) END AS symbol
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN g ON c_custkey % 4 < 2 AND c_custkey % 3 <> 0 AND lower(alias) = lower(n_name) GROUP BY c_custkey""")
def flt_declared(spark, d):
    """FLT-11: the alias opens the text, after an article or none, as whole words, and the cue is in the evidence"""
    n = table(spark, d, "nation")
    registry = n.select(c("n_name").alias("alias"), F.lit("is  a").alias("evidence_cue"), F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("symbol"))
    registry = registry.union(n.where("n_nationkey = 5").select(F.lower("n_name"), F.lit("is a"), F.lit("twice")))
    text = F.when(_key("c_custkey", 4) == 0, F.concat(F.lit("The "), "n_name", F.lit(" holds"))).when(_key("c_custkey", 4) == 1, c("n_name")).when(_key("c_custkey", 4) == 2, F.concat("n_name", F.lit("x"))).otherwise(F.concat(F.lit("in "), "n_name"))
    rows = table(spark, d, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("id"), text.alias("text"), F.when(_key("c_custkey", 3) == 0, "It was.").otherwise("It IS a case.").alias("evidence"))
    return R.declaration_matches(rows, registry).select("id", "n_matches", "symbol")


# ---------------------------------------------------------------- counts


def _diagnosed(spark, d):
    i = c("doc_id")
    rows = table(spark, d, "labels").select(
        F.when(i % 31 == 0, "abstain").otherwise("eval").alias("split"), F.when(i % 2 == 0, "reviewed").otherwise("draft").alias("status"), (c("quality") == 1).alias("formalizable"), (i % 12 == 5).alias("from_review"), F.lit("a").alias("cnl"), F.lit("k").alias("kif"),
        F.when(i % 5 == 0, None).when(i % 5 < 3, " a ").otherwise("b").alias("predicted"), F.when(i % 7 == 0, None).when(i % 7 < 4, "k").otherwise("z").alias("compiled"), (i % 11 != 0).alias("grounded"), F.when(i % 13 == 0, "no_model").when(i % 13 == 1, "compile: x").when(i % 13 == 2, "boom").alias("error"))
    return rows.withColumn("bucket", R.bucket())


BUCKETED = """(SELECT quality = 1 AS formal, CASE
WHEN doc_id % 31 = 0 OR (doc_id % 2 = 0 AND quality <> 1) THEN CASE WHEN doc_id % 5 <> 0 THEN 'wrong_cnl' WHEN doc_id % 13 > 2 THEN 'correct' WHEN doc_id % 13 = 0 THEN 'abstained' ELSE 'wrong_cnl' END
WHEN doc_id % 12 = 5 THEN 'review_only' WHEN doc_id % 13 = 0 THEN 'abstained' WHEN doc_id % 13 = 2 THEN 'error' WHEN doc_id % 5 = 0 THEN CASE WHEN quality = 1 THEN 'abstained' ELSE 'correct' END
WHEN doc_id % 7 = 0 THEN 'compile_failed' WHEN doc_id % 11 = 0 THEN 'grounding_rejected' WHEN doc_id % 5 > 2 THEN 'wrong_cnl' WHEN doc_id % 7 < 4 THEN 'correct' ELSE 'wrong_kif' END AS bucket FROM labels)"""


@query(f"SELECT u.b AS bucket, count(bucket) AS n FROM (SELECT unnest(['correct', 'wrong_kif', 'wrong_cnl', 'grounding_rejected', 'compile_failed', 'abstained', 'review_only', 'error']) AS b) u LEFT JOIN {BUCKETED} ON bucket = u.b GROUP BY 1")
def agg_buckets(spark, d):
    """AGG-06: zeros too"""
    return R.with_zeros(_diagnosed(spark, d), "bucket", R.BUCKETS)


@query(f"""SELECT count(*) AS total, count_if(bucket <> 'review_only') AS scored, count_if(bucket = 'correct' AND formal) AS correct_positive, count_if(bucket = 'correct' AND NOT formal) AS correct_abstain,
count_if(bucket = 'correct') * 100.0::DOUBLE / nullif(count_if(bucket <> 'review_only'), 0) AS accuracy FROM {BUCKETED}""")
def agg_diagnosis(spark, d):
    """AGG-06"""
    return R.diagnosis(_diagnosed(spark, d))


@query("""WITH r AS (SELECT p_partkey AS line, CASE WHEN p_size = 3 THEN 'unknown' ELSE p_type END AS pattern, ['Ferry subclass-of Vessel', '?x is-a Ferry', 'Ferry subclass-of Moon', 'Ferry subclass'][p_size % 4 + 1] AS cnl,
unnest(CASE p_size % 4 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN ['valid_closed_cnl'] ELSE ['valid_closed_cnl', 'kif_mismatch'] END WHEN 1 THEN ['free variable'] WHEN 2 THEN ['unknown class'] ELSE ['syntax'] END) AS kind FROM part)
SELECT pattern, kind, count(*) AS n, min(line) AS line, arg_min(cnl, line) AS cnl FROM r GROUP BY 1, 2""")
def agg_targets(spark, d):
    """AGG-07: all parts as targets, compiled over a closed vocabulary"""
    text = F.element_at(F.array(*map(F.lit, ("Ferry subclass-of Vessel", "?x is-a Ferry", "Ferry subclass-of Moon", "Ferry subclass"))), c("p_size") % 4 + 1)
    rows = table(spark, d, "part").select(c("p_partkey").alias("line"), F.when(c("p_size") == 3, "").otherwise(c("p_type")).alias("pattern"), text.alias("cnl"), F.when(c("p_partkey") % 2 == 0, "(subclass Ferry Vessel)").alias("want"))
    got = C.compile_cnl(rows, FX.frame(spark, FX.CLASSES, "seq int, term string"), FX.frame(spark, FX.RELATIONS, "term string, arity int"), closed=True)
    return R.target_audit(got.withColumn("kind", C.error_kind(c("error"))).withColumnsRenamed({"kif": "compiled", "want": "kif"}))


@query("""WITH r AS (SELECT p_type AS pattern, p_size % 3 = 0 AS exact, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS want, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_brand ELSE 'z' END AS got FROM part)
SELECT pattern, count(*) AS total, count(want) AS expected_valid_cnl, count(*) - count(want) AS expected_invalid_cnl, count_if(want = got) AS exact_kif_on_valid_targets, count_if(want IS NULL AND exact) AS copied_invalid_target, count(got) AS valid_cnl, count_if(exact) AS exact_cnl,
count_if(want = got)::DOUBLE / nullif(count(want), 0) AS exact_share FROM r GROUP BY ROLLUP (pattern)""")
def agg_validation(spark, d):
    """AGG-09"""
    s = c("p_size")
    rows = table(spark, d, "part").select(c("p_type").alias("pattern"), c("p_name").alias("cnl"), F.when(s % 3 == 0, c("p_name")).otherwise("b").alias("generated"), F.when(s % 5 != 0, c("p_brand")).alias("expected_kif"), F.when(s % 7 == 0, None).when(s % 2 == 0, c("p_brand")).otherwise("z").alias("generated_kif"))
    return R.validation_counts(rows)


def _scored(spark, d):
    n = c("l_linenumber")
    return table(spark, d, "lineitem").select(c("l_returnflag").alias("mode"), F.when(n < 3, "valid_cnl_other_formula").when(n < 5, "exact").otherwise("abstained").alias("route"), (c("l_quantity") > 25).alias("exact"), F.when(n != 2, c("l_linestatus") == "F").alias("grounded"),
        F.when(n != 1, c("l_suppkey") % 2 == 0).alias("declared"), F.when(c("l_suppkey") % 2 == 0, "").otherwise("unstated_parent").alias("reason"), (c("l_partkey") % 3 == 0).alias("saved"))


SCORED = "(SELECT l_returnflag AS mode, l_linenumber AS n, l_quantity > 25 AS exact, l_linenumber <> 2 AND l_linestatus = 'F' AS grounded, l_linenumber <> 1 AND l_suppkey % 2 = 0 AS declared, l_suppkey % 2 AS odd, l_partkey % 3 = 0 AS saved FROM lineitem)"


@query(f"""SELECT mode, count_if(exact) AS exact, count_if(n < 3) AS compiled_other, count_if(grounded) AS grounder_accepted, count_if(declared) AS declared_accepted, count_if(declared AND exact) AS declared_exact, count_if(declared AND NOT exact) AS declared_other,
count_if(saved) AS saved_accepted, count_if(saved AND NOT exact) AS saved_other FROM {SCORED} GROUP BY mode""")
def agg_declarations(spark, d):
    """AGG-12"""
    return R.declaration_scores(_scored(spark, d))


@query(f"""SELECT mode, 'route' AS of, CASE WHEN n < 3 THEN 'valid_cnl_other_formula' WHEN n < 5 THEN 'exact' ELSE 'abstained' END AS value, count(*) AS n FROM {SCORED} GROUP BY ALL
UNION ALL SELECT mode, 'reason', CASE odd WHEN 0 THEN 'accepted' ELSE 'unstated_parent' END, count(*) FROM {SCORED} WHERE n <> 1 GROUP BY ALL""")
def agg_declaration_reasons(spark, d):
    """AGG-12: histograms of routes and reasons"""
    return R.score_histograms(_scored(spark, d))


@query("""WITH r AS (SELECT p_size % 2 = 0 AS good, p_size % 4 = 0 AS meta, p_type FROM part), b AS (SELECT good, p_type AS v FROM r UNION ALL SELECT good, 'META' FROM r WHERE meta)
SELECT 'verdict' AS of, 'expressible' AS value, count_if(good) AS n FROM r UNION ALL SELECT 'verdict', 'partial', 0 UNION ALL SELECT 'verdict', 'blocked', count_if(NOT good) FROM r UNION ALL SELECT 'expressible', 'bibliographic', count_if(good AND meta) FROM r
UNION ALL SELECT 'expressible', 'substantive', count_if(good AND NOT meta) FROM r UNION ALL SELECT 'blockers_all', v, count(*) FROM b GROUP BY v UNION ALL SELECT 'blockers_blocked', v, count(*) FROM b WHERE NOT good GROUP BY v""")
def agg_triage(spark, d):
    """AGG-14"""
    s = c("p_size")
    return R.triage(table(spark, d, "part").select(F.when(s % 2 == 0, "expressible").otherwise("blocked").alias("verdict"), F.concat("p_type", F.lit(","), F.when(s % 4 == 0, "META").otherwise("")).alias("blockers")))


@query("SELECT l_returnflag AS pattern, count(*) AS generated, count_if(l_linenumber <= 2) AS written, count_if(l_linenumber <= 2 AND l_linestatus = 'F') AS focused FROM lineitem GROUP BY 1")
def agg_prepared(spark, d):
    """AGG-16"""
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "pattern")
    return R.prepared_counts(rows, rows.where("l_linenumber <= 2"), c("l_linestatus") == "F")


@query("""WITH r AS (SELECT doc_id % 4 <> 0 AS reviewed, doc_id % 6 = 1 AS seen, quality = 1 AS formal, toxic = 1 AS novel, doc_id % 9 = 2 AS ai FROM labels), e AS (SELECT *, reviewed AND NOT seen AS el FROM r)
SELECT count(*) AS records, count_if(reviewed) AS reviewed_test, count_if(el) AS eligible, count_if(el AND formal) AS positive, count_if(el AND formal AND novel) AS novel, count_if(el AND ai) AS ai_reviewed, 'blocked' AS status,
array_to_string(list_filter([CASE WHEN count_if(seen) > 0 THEN 'training overlap' END, CASE WHEN count_if(el AND ai) > 0 THEN 'labels of a machine' END, CASE WHEN count_if(el AND formal AND novel) = 0 THEN 'no novel positive' END, CASE WHEN count_if(el AND NOT formal) = 0 THEN 'no abstention' END], lambda x: x IS NOT NULL), ',') AS blockers FROM e""")
def val_preflight(spark, d):
    """AGG-17"""
    i = c("doc_id")
    rows = table(spark, d, "labels").select(F.when(i % 4 == 0, "draft").when(i % 4 == 1, "reviewed").otherwise("accepted").alias("status"), F.lit("eval").alias("split"), (i % 6 == 1).alias("overlaps"), F.when(i % 9 == 2, "ai").alias("reviewer_type"), (c("quality") == 1).alias("formalizable"), (c("toxic") != 1).alias("restates"), F.lit(False).alias("scope_error"))
    return R.study_preflight(rows, training_given=True).select("records", "reviewed_test", "eligible", "positive", "novel", "ai_reviewed", "status", F.array_join("blockers", ",").alias("blockers"))


@query("SELECT n_name AS parent, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_custkey % 2 = 0 AND n_nationkey < 10 GROUP BY 1")
def agg_choices(spark, d):
    """AGG-19: choices of each parent, zeros too"""
    n = table(spark, d, "nation").withColumnRenamed("n_name", "parent")
    chosen = table(spark, d, "customer").where("c_custkey % 2 = 0").join(n.where("n_nationkey < 10"), c("c_nationkey") == c("n_nationkey"))
    return R.with_zeros(chosen, "parent", n)


@query()
def win_stratified(spark, d):
    """WIN-10: 60 sentences of all documents, dealt out over six tags in rounds; benchmark texts are out"""
    s = S.sentences(table(spark, d, "documents"))
    rows = s.select((c("doc_id") * 1000000 + c("position")).alias("record_id"), c("sentence").alias("nl"), X.phenomena(c("sentence")).alias("phenomena"))
    return R.stratified(rows, 60, excluded=table(spark, d, "benchmark").select(c("text").alias("nl"))).select("record_id", "picked_as", "pick", "nl")


# ---------------------------------------------------------------- memories, vocabulary, proofs


@query("SELECT 'memory:' || p_partkey AS statement_id, 'P' || p_size AS child, p_type AS parent, p_partkey AS line, CASE WHEN p_size % 5 = 0 THEN 'P' || p_size END AS unknown FROM part WHERE p_partkey % 3 <> 0")
def src_memory(spark, d):
    """SRC-16: full-line statements only; unknown terms are told"""
    p = table(spark, d, "part")
    child = F.concat(F.lit("P"), c("p_size").cast("string"))
    text = F.concat(F.when(c("p_partkey") % 3 == 0, "; "), F.lit(" (subclass "), child, F.lit("  "), "p_type", F.lit(" ) "))
    lines = p.select(c("p_partkey").alias("line"), F.coalesce(text, F.concat(F.lit(" (subclass "), child, F.lit("  "), "p_type", F.lit(" ) "))).alias("text"))
    known = p.where("p_size % 5 <> 0").select(child.alias("term")).union(p.select("p_type"))
    return R.ontology_memory(lines, known)


@query("SELECT 'prior-claim:' || l_orderkey AS statement_id, CASE WHEN l_linenumber <> 2 THEN 'L' || l_partkey END AS child, CASE WHEN l_linenumber <> 2 THEN 'S' || l_suppkey END AS parent, l_partkey AS line, CASE WHEN l_linenumber = 2 THEN 'no subclass claim' END AS fault FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 1 AND l_quantity > 10")
def src_prior_claims(spark, d):
    """SRC-17: one mode, and only rows that are surely accepted"""
    kif = F.concat(F.when(c("l_linenumber") == 2, "(instance L").otherwise("(subclass L"), c("l_partkey").cast("string"), F.lit(" S"), c("l_suppkey").cast("string"), F.lit(")"))
    rows = table(spark, d, "lineitem").select(c("l_partkey").alias("line"), c("l_orderkey").alias("record_id"), c("l_returnflag").alias("mode"), F.when(c("l_linenumber") != 1, c("l_quantity") > 10).alias("accepted"), kif.alias("kif"))
    return R.prior_claims(rows, mode="R")


@query("SELECT DISTINCT 'nl' AS kind, text FROM (SELECT text FROM benchmark UNION SELECT text FROM conversations) WHERE text <> '' UNION ALL SELECT DISTINCT 'cnl', role FROM conversations WHERE role <> ''")
def src_overlap_sets(spark, d):
    """SRC-22"""
    bench = table(spark, d, "benchmark").select(c("text").alias("nl"), F.lit(None).cast("string").alias("cnl"))
    return R.overlap_sets([bench, table(spark, d, "conversations").select(c("text").alias("nl"), c("role").alias("cnl"))])


@query("SELECT 'T' || p_partkey AS term, p_size >= 10 AS fallback FROM part WHERE p_size < 10 OR (p_size <= 45 AND p_partkey % 2 = 0)")
def src_documented(spark, d):
    """RSN-15: documented terms in capitals that are neither class nor relation become classes"""
    p = table(spark, d, "part")
    term = F.concat(F.lit("T"), c("p_partkey").cast("string"))
    docs = p.select(F.when(c("p_partkey") % 2 == 0, term).otherwise(F.lower(term)).alias("term"))
    return R.documented_classes(docs, p.where("p_size < 10").select(term.alias("term")), p.where("p_size > 45").select(term.alias("term")))


@query(r"""WITH c AS (SELECT DISTINCT p_brand AS t FROM part), r AS (SELECT DISTINCT lower(p_type) AS t FROM part)
SELECT 'class' AS name, string_agg(regexp_replace(t, '([^A-Za-z0-9_])', '\\\1', 'g'), '|' ORDER BY length(t) DESC, t) AS pattern, 'class ::= ' || string_agg('"' || t || '"', ' | ' ORDER BY length(t) DESC, t) AS rule FROM c
UNION ALL SELECT 'rel', string_agg(t, '|' ORDER BY length(t) DESC, t), 'rel ::= ' || string_agg('"' || t || '"', ' | ' ORDER BY length(t) DESC, t) FROM r""")
def cmp_grammar(spark, d):
    """CMP-17, SRT-01: closed alternations of a vocabulary, longest first, as patterns and as grammar rules"""
    p = table(spark, d, "part")
    classes, relations = p.select(c("p_brand").alias("term")), p.select(F.lower("p_type").alias("term"))
    rules = R.grammar(classes, relations).where("seq > 8").select(F.substring_index("rule", " ", 1).alias("name"), "rule")
    both = R.alternation(classes).select(F.lit("class").alias("name"), c("text").alias("pattern")).union(R.alternation(relations).select(F.lit("rel"), "text"))
    return rules.join(both, "name")


@query("SELECT c_custkey AS id, array_to_string(list_sort(['c' || c_custkey, 'n' || n_nationkey, 'r' || n_regionkey]), ',') AS records FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rsn_proofs(spark, d):
    """RSN-08: the facts that a shortest proof uses, for a question about each customer"""
    k = lambda p, n: F.concat(F.lit(p), c(n).cast("string"))
    cust, nat, reg = (table(spark, d, t) for t in ("customer", "nation", "region"))
    fact = lambda df, rid, rel, a, b: df.select(rid.alias("record_id"), F.lit(rel).alias("relation"), a.alias("left"), b.alias("right"), F.lit(False).alias("negative"))
    facts = fact(cust, k("c", "c_custkey"), "instance", k("C", "c_custkey"), k("N", "c_nationkey")).union(fact(nat, k("n", "n_nationkey"), "subclass", k("N", "n_nationkey"), k("R", "n_regionkey"))).union(fact(reg, k("r", "r_regionkey"), "subclass", k("R", "r_regionkey"), F.lit("World")))
    asked = cust.select(c("c_custkey").alias("id"), F.lit("instance").alias("relation"), k("C", "c_custkey").alias("left"), F.lit("World").alias("right"))
    return K.proofs(facts, asked).select("id", F.array_join("records", ",").alias("records"))


@query("SELECT * FROM (VALUES ('sound', 'satisfiable'), ('broken', 'unsatisfiable'), ('other', 'unsupported')) t(bundle, status)")
def rsn_bundles(spark, d):
    """RSN-11: all nations as a bundle, one that contradicts it through two steps, and one with a rule in it"""
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), c("n_nationkey").cast("string")).alias("record_id"), F.concat(F.lit("(subclass N"), c("n_nationkey").cast("string"), F.lit(" R"), c("n_regionkey").cast("string"), F.lit(")")).alias("kif"))
    more = lambda *kifs: n.union(FX.frame(spark, [(f"x{k}", x) for k, x in enumerate(kifs)], "record_id string, kif string"))
    told = {"sound": n, "broken": more("(instance Spot N1)", "(subclass R1 World)", "(not (instance Spot World))"), "other": more("(=> (instance ?x N1) (instance ?x R1))")}
    rows = [K.bundle_status(b).select(F.lit(name).alias("bundle"), "status") for name, b in told.items()]
    return rows[0].union(rows[1]).union(rows[2])


# ---------------------------------------------------------------- passages


@query()
def prj_spans(spark, d):
    """PRJ-29, FLT-10: all documents as passages; their sentences with places, up to the first definition; rows only, tests hold the rules"""
    rows = S.spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("first", X.first_sentence(c("text")))
    return S.screened(S.spans(rows, "doc_id"), "doc_id")


@query("SELECT * FROM (VALUES ('a', '2-7', '2-14', 'A tug is a small vessel that tows. It waits in port.', 'A tug is a small vessel that tows.'), ('a', '2-7', '2-15', 'Pilots guide the tugs into the port.', 'Pilots guide the tugs into the port.')) t(page_id, page, paragraph, excerpt, nl)")
def prj_paragraphs(spark, d):
    """PRJ-22"""
    page = "Chapter 2\nlost line\n2-14. A tug is a small vessel that tows.\n\n It waits in port. \nFigure 2 shows one\nnot kept\n2-15. Pilots guide the tugs\ninto the port.\nALL CAPITALS\n2-16. Too short.\n3-1. Another chapter has this one here.\n2-7 FM 9-9 1 May 2021"
    got = S.numbered_paragraphs(FX.frame(spark, [("a", 2, page), ("b", 2, ""), ("c", 2, None)], "page_id string, chapter int, text string"), "FM 9-9")
    return got.select("page_id", "page", "paragraph", "excerpt", "nl")
