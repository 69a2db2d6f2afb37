"""The engine's queries over the driver's tables and small authored fixtures, each with its SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cnl as C
from ..functions import text as X
from ..operators import audit as A
from ..operators import baseline as B
from ..operators import candidates as N
from ..operators import definitions as D
from ..operators import ingest as I
from ..operators import knowledge as K
from ..operators import pairs as P
from ..operators import routing as R
from ..operators import segment as S
from ..sources import artifacts as ART
from ..sources import kif as KIF
from ..sources import records as REC
from . import fixtures as FX
from .lineage import scratch
from .registry import SQL, Q, query, table
from .sql import BLANK, bounded, noise, phenomena_list, scoped, squash, unsupported, values, words

PIECES = rf"""(SELECT doc_id, lang, i AS k, {squash('p')} AS sentence
  FROM (SELECT doc_id, lang, unnest(parts) AS p, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?]){BLANK}', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)))"""
IS_SENT = rf"({words('sentence')} >= 5 AND regexp_matches(sentence, '\p{{L}}') AND NOT regexp_matches(sentence, '^\s*([▪⚫•◦●■]|[-*] )'))"
SENT = f"(SELECT doc_id, lang, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position FROM {PIECES} WHERE {IS_SENT})"


# ---------------------------------------------------------------- segmentation and windows


@query(f"SELECT doc_id, position::INT AS position, sentence FROM {SENT}")
def prj_sentences(spark, d):
    """PRJ-05, WIN-02"""
    return S.sentences(table(spark, d, "documents"))


@query(f"SELECT doc_id, position::INT AS position, sentence FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY doc_id, position) AS n FROM {SENT}) WHERE n = 1")
def prj_first_seen(spark, d):
    """PRJ-06, WIN-03: first-wins over the corpus, positions counted before"""
    return S.first_seen(S.sentences(table(spark, d, "documents")), "sentence", "doc_id", "position").select("doc_id", "position", "sentence")


ROUTE = f"CASE WHEN {noise('sentence')} THEN 'reject' WHEN {unsupported('sentence')} THEN 'abstain' WHEN {scoped('sentence')} THEN 'review' ELSE 'candidate' END"


@query(f"SELECT lang, {ROUTE} AS route, count(*) AS n, sum({words('sentence')})::BIGINT AS n_words FROM {SENT} GROUP BY 1, 2")
def flt_route_histogram(spark, d):
    """FLT-01, FLT-02, FLT-05, AGG-13: the flagship"""
    docs = S.spread(table(spark, d, "documents").select("lang", "text"))
    parts = docs.select("lang", F.explode(X.sentences(F.col("text"))).alias("sentence")).where(X.is_sentence(F.col("sentence")))
    return S.routed(parts, squashed=True).groupBy("lang", "route").agg(F.count(F.lit(1)).alias("n"), F.sum(X.n_squashed(F.col("sentence"))).cast("long").alias("n_words"))


@query(f"SELECT t AS tag, count(*) AS n FROM (SELECT unnest({phenomena_list('sentence')}) AS t FROM {SENT}) GROUP BY 1")
def agg_phenomena(spark, d):
    """PRJ-23, AGG-18"""
    return S.sentences(table(spark, d, "documents")).select(F.explode(X.phenomena(F.col("sentence"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, CASE WHEN len(regexp_split_to_array(trim(s), '\s+')) >= 6 AND regexp_matches(s, '[.!?]$') THEN s END AS first FROM (
  SELECT doc_id, replace(trim(string_split(regexp_replace(replace(replace(replace(text, 'U.S.', 'U․S․'), 'e.g.', 'e․g․'), 'i.e.', 'i․e․'), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))[1], ' '  || chr(10)), '․', '.') AS s FROM documents)""")
def prj_first_sentence(spark, d):
    """PRJ-21"""
    return table(spark, d, "documents").select("doc_id", X.first_sentence(F.trim(F.col("text"), F.lit(" \n"))).alias("first"))


@query(f"SELECT doc_id, md5(lower({squash('text')})) AS key_md5, {words('text')} AS n_words FROM documents")
def prj_text_key(spark, d):
    """PRJ-07, PRJ-24"""
    return table(spark, d, "documents").select("doc_id", F.md5(X.text_key(F.col("text"))).alias("key_md5"), X.n_words(F.col("text")).cast("long").alias("n_words"))


@query(f"""SELECT conv_id, turn, len(ctx)::INT AS n_context, coalesce(array_to_string(ctx, '|'), '') AS context, 'p' || conv_id || '-pos' || turn || '-n' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS record_id
FROM (SELECT conv_id, turn, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS ctx FROM conversations)""")
def win_context(spark, d):
    """WIN-01, PRJ-26"""
    from pyspark.sql import Window as W

    got = S.with_context(table(spark, d, "conversations"), "conv_id", "turn", "text")
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return got.select("conv_id", "turn", F.size("context").alias("n_context"), F.array_join("context", "|").alias("context"), F.format_string("p%d-pos%d-n%d", "conv_id", "turn", n).alias("record_id"))


@query("""SELECT conv_id, turn, CASE WHEN len(ctx) > 0 THEN 'Context:' || chr(10) || array_to_string(list_transform(ctx, lambda x, i: i || '. ' || x), chr(10)) || chr(10) ELSE '' END || 'Sentence: ' || text AS prompt
FROM (SELECT conv_id, turn, text, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS ctx FROM conversations)""")
def prj_prompt(spark, d):
    """PRJ-08, PRJ-25"""
    got = S.with_context(table(spark, d, "conversations"), "conv_id", "turn", "text", 2)
    return got.select("conv_id", "turn", S.prompt(F.col("text"), F.col("context")).alias("prompt"))


@query(rf"""SELECT doc_id, count(*) AS n_lines, sum(h::INT)::BIGINT AS n_headings FROM (
  SELECT doc_id, line <> '' AND NOT ends_with(line, '.') AND len(w) < 10 AND (upper(line) = line OR len(list_filter(w, lambda x: NOT (x = '' OR upper(x) = x OR lower(x) IN ('a','an','and','at','by','for','from','in','of','on','or','the','to','with') OR regexp_matches(x, '^\p{{Lu}}')))) = 0) AS h
  FROM (SELECT doc_id, line, list_transform(list_filter(string_split(line, ' '), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[()\[\]{{}}:,;/-]+', ''), '[()\[\]{{}}:,;/-]+$', '')) AS w
    FROM (SELECT doc_id, {squash("unnest(string_split(text, chr(10)))")} AS line FROM documents))) GROUP BY 1""")
def prj_headings(spark, d):
    """PRJ-03"""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", X.squash(F.col("raw")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(X.is_heading(F.col("line"))).alias("n_headings"))


@query()
def prj_blocks(spark, d):
    """PRJ-04, WIN-11: rows only; tests hold the rules"""
    return S.blocks(table(spark, d, "documents")).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("block").alias("n_blocks"))


@query(values(FX.LINES, ["id", "line", "want"], "SELECT id, want AS cleaned"))
def prj_clean_line(spark, d):
    """PRJ-01, PRJ-02: each line beside the result that the rules give"""
    return FX.frame(spark, FX.LINES, "id int, line string, want string").select("id", X.clean_line(F.col("line")).alias("cleaned"))


@query(values(FX.TERMS, ["term", "spaced", "article", "plural", "singular"], "SELECT term, spaced, term AS again, article, singular"))
def prj_terms(spark, d):
    """PRJ-14, PRJ-15, PRJ-16, PRJ-18"""
    t = FX.frame(spark, FX.TERMS, "term string, spaced string, article string, plural string, singular string")
    s = X.spaced(F.col("term"))
    return t.select("term", s.alias("spaced"), X.pascal(F.when(F.col("term") == "USArmy", F.lit("US Army")).otherwise(F.initcap(s))).alias("again"), X.article(s).alias("article"), X.singular(F.col("plural")).alias("singular"))


@query("""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM benchmark),
p AS (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS k FROM w),
g AS (SELECT DISTINCT item_id, array_to_string(t[k:k + n - 1], ' ') AS gram FROM p, range(1, 7) a(n) WHERE k + n - 1 <= len(t))
SELECT item_id, count(*) AS n_grams, md5(string_agg(gram, '|' ORDER BY gram)) AS grams_md5 FROM g GROUP BY 1""")
def prj_ngrams(spark, d):
    """PRJ-20"""
    t = table(spark, d, "benchmark").select("item_id", F.explode(X.ngrams(X.words(F.col("text")))).alias("gram"))
    return t.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_grams"), F.md5(F.array_join(F.array_sort(F.collect_list("gram")), "|")).alias("grams_md5"))


@query(r"""SELECT page_id, CASE WHEN length(s) < 10 THEN '' ELSE s END AS doc FROM (SELECT page_id, substr(regexp_extract(""" + squash("replace(regexp_replace(html, '<[^>]*>|&%', '', 'g'), '\"', '')") + r""", '^([^.]*\.?)', 1), 1, 300) AS s FROM pages)""")
def prj_clean_doc(spark, d):
    """PRJ-17"""
    return table(spark, d, "pages").select("page_id", X.clean_doc(F.col("html")).alias("doc"))


# ---------------------------------------------------------------- filters


@query(f"""SELECT doc_id, position::INT AS position, {bounded('sentence', r'(is|are|was|were)\s+(an?|the|some)')} AS copular, {bounded('sentence', r'some|there\s+is|there\s+are|exists|exist|at\s+least\s+one')} AS existential,
{bounded('sentence', 'subclass|kind of|type of|class of')} AS subclass, (regexp_matches(sentence, '^(every|each|all|no)($|[^\\p{{L}}\\p{{N}}_])', 'i') OR {bounded('sentence', 'if')}) AS conditional, {bounded('sentence', 'not|no|never')} AS negation,
({bounded('sentence', 'among')} OR regexp_matches(sentence, '\\[[^\\]]+,')) AS nary FROM {SENT}""")
def flt_shapes(spark, d):
    """FLT-03"""
    return S.sentences(table(spark, d, "documents")).select("doc_id", "position", *[c.alias(k) for k, c in X.shapes(F.col("sentence")).items()])


@query(f"SELECT doc_id, position::INT AS position, {scoped('sentence')} AS scoped, len(list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), lambda w: list_contains(['the', 'and', 'thor', 'des'], w))) > 0 AS focus FROM {SENT}")
def flt_scope_focus(spark, d):
    """FLT-05, FLT-06"""
    s = S.sentences(table(spark, d, "documents"))
    toks = F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), 0)
    return s.select("doc_id", "position", X.scoped(F.col("sentence")).alias("scoped"), F.arrays_overlap(toks, F.array(*map(F.lit, ("the", "and", "thor", "des")))).alias("focus"))


@query(values(FX.DEFINITIONS, ["id", "sentence", "reason", "subject", "head"], "SELECT id, reason, subject, head"))
def flt_definition_head(spark, d):
    """FLT-09"""
    t = FX.frame(spark, FX.DEFINITIONS, "id int, sentence string, reason string, subject string, head string")
    return t.select("id", *[c.alias(k) for k, c in X.definition_head(F.col("sentence")).items()])


@query(values(FX.COMPOUNDS, ["id", "sentence", "parts"], "SELECT id, parts"))
def prj_decompose(spark, d):
    """PRJ-13, FLT-04"""
    return FX.frame(spark, FX.COMPOUNDS, "id int, sentence string, want string").select("id", F.array_join(I.decomposed(F.col("sentence")), "|").alias("parts"))


@query(values(FX.LINKED, ["id", "text", "linked"], "SELECT id, linked"))
def prj_linked(spark, d):
    """PRJ-12"""
    rows = FX.frame(spark, FX.LINKED, "id int, text string, want string")
    return I.linked(rows, _known(spark), key="id", text="text", abbreviations={"HP": "HarbourPilot", "XX": "Nowhere"}).select("id", F.col("text").alias("linked"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_-])(the)($|[^A-Za-z0-9_-])', '\\1The\\3', 'gi'), '(^|[^A-Za-z0-9_-])(the)($|[^A-Za-z0-9_-])', '\\1The\\3', 'g'), '(^|[^A-Za-z0-9_-])(of)($|[^A-Za-z0-9_-])', '\\1Origin\\3', 'gi'), '(^|[^A-Za-z0-9_-])(of)($|[^A-Za-z0-9_-])', '\\1Origin\\3', 'g') AS linked FROM conversations")
def prj_linked_turns(spark, d):
    """PRJ-12 over all turns: two terms, one by its abbreviation"""
    rows = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn", F.monotonically_increasing_id().alias("n")))
    return I.linked(rows, FX.frame(spark, [("The",), ("Origin",)], "term string"), key="key", text="text", abbreviations={"of": "Origin"}).select("conv_id", "turn", F.col("text").alias("linked"))


def _ingested(spark, rows, keep=()):
    relations = FX.frame(spark, [*((r[0], 3 if r[0] == "between" else 2) for r in FX.ROUTE_RELATIONS)], "term string, arity int")
    return I.ingested(rows, _known(spark), relations, background=_background(spark), keep=keep)


@query(values([(i, k, *row) for i, _, out in FX.INGESTED for k, row in enumerate(out)], ["id", "k", "subclaim", "route", "reason", "cnl"], "SELECT id, subclaim, route, reason, cnl"))
def ing_routes(spark, d):
    """The chain of PRJ-12, PRJ-13, FLT, RTE, CMP, GRD to three routes; WIN-04"""
    return _ingested(spark, FX.frame(spark, [r[:2] for r in FX.INGESTED], "sentence_id int, sentence string")).select(F.col("sentence_id").alias("id"), "subclaim", "route", "reason", "cnl")


@query()
def ing_documents(spark, d):
    """AGG-02: the same chain over all sentences of all documents, counted by language; rows only, tests hold the rules"""
    s = S.sentences(table(spark, d, "documents"), keep=("lang",))
    rows = s.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("position").cast("string")).alias("sentence_id"), "sentence", "lang")
    return I.run_counters(_ingested(spark, rows, ("lang",)), ["lang"])


# ---------------------------------------------------------------- controlled language


@query(values(FX.CNL, ["id", "cnl", "kif", "kind", "closed_kind", "pattern"], "SELECT id, kif, kind, closed_kind, pattern"))
def cmp_compile(spark, d):
    """CMP-01 to CMP-13, CMP-15, CMP-20, GRD-01"""
    rows = FX.frame(spark, FX.CNL, "id int, cnl string, want string, k string, ck string, p string").select("id", "cnl")
    classes, relations = FX.frame(spark, FX.CLASSES, "seq int, term string"), FX.frame(spark, FX.RELATIONS, "term string, arity int")
    one = C.compile_cnl(rows, classes, relations)
    two = C.compile_cnl(rows, classes, relations, closed=True).select("id", C.error_kind(F.col("error")).alias("closed_kind"))
    return one.select("id", "kif", C.error_kind(F.col("error")).alias("kind"), C.classify(F.col("cnl")).alias("pattern")).join(two, "id")


@query("SELECT * FROM (VALUES (1, NULL), (2, 'argument kind: class for an instance: guides/1'), (3, 'argument kind: variable for a class: guides/2'), (4, 'argument kind: no kind: located/1'), (5, NULL), (6, NULL), (7, 'unknown class: Moon')) t(id, error)")
def cmp_kinds(spark, d):
    """CMP-14, CMP-16"""
    rows = FX.frame(spark, [(1, "guides ?x Ferry"), (2, "guides Pilot Ferry"), (3, "guides ?x ?y"), (4, "every ?x is-a Ferry implies located ?x Port"), (5, "?x is-a Ferry"), (6, "Dredger subclass-of Vessel"), (7, "Moon subclass-of Vessel")], "id int, cnl string")
    kinds = FX.frame(spark, [("guides", 1, "instance"), ("guides", 2, "subclass")], "term string, position int, kind string")
    got = C.compile_cnl(rows, FX.frame(spark, FX.CLASSES, "seq int, term string"), FX.frame(spark, FX.RELATIONS, "term string, arity int"), kinds=kinds, declared=FX.frame(spark, [("Dredger",)], "term string"))
    return got.select("id", "error")


@query("SELECT id, array_to_string(list_filter(regexp_extract_all(cnl, '[?]?[A-Za-z][A-Za-z0-9_]*(?:-[a-z]+)?'), lambda w: NOT list_contains(['is-a','subclass-of','not','every','some','no','if','and','then','implies'], w) AND w[1] <> '?'), '|') AS terms FROM (" + values([r[:2] for r in FX.CNL if r[0] < 5], ["id", "cnl"], "SELECT *") + ")")
def cmp_terms(spark, d):
    """CMP-19"""
    return FX.frame(spark, [r[:2] for r in FX.CNL if r[0] < 5], "id int, cnl string").select("id", F.array_join(C.cnl_terms(F.col("cnl")), "|").alias("terms"))


@query(values(FX.GATE, ["id", "cnl", "source", "rel", "cls", "pattern", "reason"], "SELECT id, pattern, coalesce(reason, 'accepted') AS reason"))
def grd_gate(spark, d):
    """GRD-01 to GRD-15, PRJ-19"""
    rows = FX.frame(spark, FX.GATE, "id int, cnl string, source string, rel string, cls string, p string, r string").select("id", "cnl", "source", F.filter(F.split("rel", ","), lambda x: x != "").alias("relations"), F.filter(F.split("cls", ","), lambda x: x != "").alias("classes"))
    return K.gate(rows, aliases={"Watercraft": ["small boat"]}, background=_background(spark)).select("id", "pattern", F.coalesce("reason", F.lit("accepted")).alias("reason"))


# ---------------------------------------------------------------- sources


KIF_SQL = values(FX.KIF, ["file", "line", "text"], "SELECT *")


@query(rf"SELECT regexp_extract(text, '^\(subclass ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)', 1) AS child, max_by(regexp_extract(text, '^\(subclass ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)', 2), (file, line)) AS parent FROM ({KIF_SQL}) WHERE regexp_matches(text, '^\(subclass ') GROUP BY 1")
def src_edges(spark, d):
    """SRC-03, SRC-05"""
    return KIF.last_parent(KIF.edges(FX.frame(spark, FX.KIF, "file string, line int, text string")))


@query(rf"SELECT DISTINCT string_split(h, ' ')[2] AS child, rtrim(string_split(h, ' ')[3], ')') AS parent FROM (SELECT unnest(regexp_extract_all(string_split(text, ';')[1], '\(subclass [A-Za-z][A-Za-z0-9_]* [A-Za-z][A-Za-z0-9_]*\)')) AS h FROM ({KIF_SQL}))")
def src_pairs(spark, d):
    """SRC-06"""
    return KIF.asserted_pairs(FX.frame(spark, FX.KIF, "file string, line int, text string"))


STATEMENTS_SQL = rf"""(SELECT m[1] AS form, m[2] AS term, coalesce(try_cast(m[3] AS INT), CASE WHEN starts_with(m[1], 'range') THEN 0 END) AS position, m[4] AS class, file, line FROM (
SELECT file, line, [regexp_extract(text, '{{p}}', 1), regexp_extract(text, '{{p}}', 2), regexp_extract(text, '{{p}}', 3), regexp_extract(text, '{{p}}', 4)] AS m FROM ({KIF_SQL})) WHERE m[1] <> '')""".replace("{p}", r"^\s*\(\s*(domain|domainSubclass|range|rangeSubclass)\s+([a-z][A-Za-z0-9_-]*)\s+([0-9]*)\s*([A-Z][A-Za-z0-9_-]*)\s*\)")


@query(f"""SELECT term, position, coalesce(max_by(class, (file, line)) FILTER (NOT ends_with(form, 'Subclass')), min_by(class, (file, line)) FILTER (ends_with(form, 'Subclass'))) AS class,
CASE WHEN bool_or(NOT ends_with(form, 'Subclass')) THEN 'instance' ELSE 'subclass' END AS kind FROM {STATEMENTS_SQL} GROUP BY 1, 2""")
def src_signatures(spark, d):
    """SRC-07, AGG-20"""
    return KIF.signatures(FX.frame(spark, FX.KIF, "file string, line int, text string"))


@query("SELECT * FROM (VALUES ('class', 'Craft', NULL, NULL), ('class', 'Ferry', NULL, NULL), ('class', 'Ada', NULL, NULL), ('class', 'Place', NULL, NULL), ('class', 'Port', NULL, NULL), ('class', 'Tug', NULL, NULL), ('class', 'Vessel', NULL, NULL), "
       "('relation', 'guides', 'BinaryPredicate', 2), ('relation', 'located', NULL, 2), ('relation', 'tows', NULL, 2), ('relation', 'weighs', 'UnaryFunction', 1), ('relation', 'lost', NULL, NULL)) t(kind, term, type, arity)")
def src_bundle(spark, d):
    """SRC-07, SRC-03, SRC-04, RSN-14: classes and relations of a bundle"""
    lines = FX.frame(spark, FX.KIF, "file string, line int, text string")
    classes = KIF.class_terms(lines).select(F.lit("class").alias("kind"), "term", F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("arity"))
    return classes.unionByName(KIF.relation_terms(lines).select(F.lit("relation").alias("kind"), "term", "type", "arity"))


@query("SELECT * FROM (VALUES ('located', 2), ('near', 2), ('inside', 2), ('agent', 2), ('odd', NULL), ('odder', NULL)) t(term, arity)")
def rsn_inherited_arity(spark, d):
    """RSN-14"""
    a = FX.frame(spark, [("located", 2), ("agent", 2)], "term string, arity int")
    up = FX.frame(spark, [("near", "located"), ("inside", "near"), ("odd", "odder"), ("odder", "odd")], "child string, parent string")
    return KIF.inherited_arities(a, up)


# ---------------------------------------------------------------- record files


@query("SELECT 'f' || p_partkey AS record_id, '(instance P' || p_partkey || ' Part)' AS kif, p_size AS page_number, p_brand AS section FROM part")
def src_facts(spark, d):
    """SRC-12, SNK-01, SNK-12: facts written as JSON lines and read back with their checks"""
    key = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("f"), key).alias("record_id"), F.concat(F.lit("(instance P"), key, F.lit(" Part)")).alias("kif"), F.col("p_size").alias("page_number"), F.col("p_brand").alias("section"))
    path = scratch(spark, "facts")
    REC.write(rows, path, "record_id")
    return REC.good(REC.read(spark, path, "fact")).select("record_id", "kif", "page_number", "section")


@query("SELECT conv_id::VARCHAR || '-' || lpad(turn::VARCHAR, 5, '0') AS nl, text AS kif FROM conversations WHERE trim(text) <> '' ORDER BY 1 LIMIT 50")
def src_training(spark, d):
    """SRC-09, SRC-10, SNK-08: pairs written in order, the first 50 read back"""
    turns = table(spark, d, "conversations")
    nl = F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 5, "0"))
    path = scratch(spark, "pairs")
    REC.write(turns.select(nl.alias("nl"), F.lit("c").alias("cnl"), F.col("text").alias("kif"), F.col("role").alias("pattern")), path, "nl")
    return REC.good(REC.read(spark, path, "pair"), limit=50).select("nl", "kif")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE text <> ''")
def src_annotations(spark, d):
    """SRC-20, SNK-11: a review table as CSV, cells over several lines"""
    path = scratch(spark, "review")
    REC.write(table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", "role", "text"), path, form="csv")
    return REC.read_table(spark, path).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@query("SELECT doc_id, position::INT AS position, sentence FROM " + SENT)
def src_sentences(spark, d):
    """SRC-02, SNK-10"""
    path = scratch(spark, "sentences")
    REC.write(S.sentences(table(spark, d, "documents")).select("sentence", F.col("doc_id").cast("int").alias("page_number"), "position", F.lit("s").alias("section")), path)
    return REC.good(REC.read(spark, path, "sentence")).select(F.col("page_number").cast("long").alias("doc_id"), "position", "sentence")


@query("SELECT term FROM (SELECT DISTINCT p_brand AS term FROM part UNION SELECT DISTINCT p_type FROM part)")
def src_vocabulary(spark, d):
    """SRC-03, SET-01, SNK-07: a vocabulary of terms from files and from statements"""
    p = table(spark, d, "part")
    path = scratch(spark, "terms")
    REC.write(p.select(F.col("p_brand").alias("term"), F.lit("").alias("doc")).distinct(), path, "term")
    return REC.good(REC.read(spark, path, "class")).select("term").union(p.select("p_type")).distinct()


@query(values([(k + 1, v) for k, (_, v) in enumerate(FX.BENCH) if v is not None], ["line", "faults"], "SELECT line, faults"))
def val_benchmark(spark, d):
    """SRC-11, VAL-01, VAL-03 (form, ids and enumerations): faults of each line of a benchmark file"""
    path = scratch(spark, "benchmark")
    spark.createDataFrame([("\n".join(r[0] for r in FX.BENCH),)], "value string").coalesce(1).write.text(path)
    return REC.read(spark, path, "benchmark").select("line", F.array_join("faults", ",").alias("faults"))


# ---------------------------------------------------------------- reasoning


PART_EDGES = "(SELECT DISTINCT 'B' || p_brand AS a, 'T' || p_type AS b FROM part UNION SELECT DISTINCT 'T' || p_type, 'S' || (p_size % 7) FROM part UNION SELECT 'S' || r_regionkey, 'S' || (r_regionkey + 1) FROM region UNION SELECT 'S6', 'S0')"


def _part_edges(spark, d):
    p = table(spark, d, "part")
    one = p.select(F.concat(F.lit("B"), "p_brand").alias("a"), F.concat(F.lit("T"), "p_type").alias("b"))
    two = p.select(F.concat(F.lit("T"), "p_type"), F.concat(F.lit("S"), (F.col("p_size") % 7).cast("string")))
    three = table(spark, d, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")), F.concat(F.lit("S"), (F.col("r_regionkey") + 1).cast("string")))
    return one.union(two).union(three).union(spark.createDataFrame([("S6", "S0")], "a string, b string")).distinct()


@query(f"WITH RECURSIVE e AS {PART_EDGES}, c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def rsn_closure(spark, d):
    """RSN-03: with cycles"""
    return K.closure(_part_edges(spark, d)).select("a", "b")


@query("SELECT c_custkey, n_name AS class FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rsn_inheritance(spark, d):
    """RSN-04"""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    up = K.closure(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))).select("a", "b")
    inst = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("class"))
    return inst.union(inst.join(up, inst["class"] == up.a).select("c_custkey", "b")).distinct()


@query(values(FX.QUESTIONS, ["id", "kif", "want"], "SELECT id, want AS status"))
def rsn_answers(spark, d):
    """RSN-01, RSN-05, RSN-06, RSN-07"""
    lit = lambda df: df.select("id", *[c.alias(k) for k, c in C.ground_literal(F.col("kif")).items()])
    return K.answers(lit(FX.frame(spark, FX.FACTS, "id int, kif string")).drop("id"), lit(FX.frame(spark, FX.QUESTIONS, "id int, kif string, want string")))


@query("SELECT 'section' AS facet, lang AS key, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids_md5 FROM documents GROUP BY 2 UNION ALL SELECT 'relation', source, count(*), md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) FROM documents GROUP BY 2")
def snk_facets(spark, d):
    """SNK-02, AGG-15"""
    recs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("relation"), F.array().cast("array<string>").alias("terms"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("page"))
    return K.facets(recs).select("facet", "key", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query("SELECT doc_id AS record_id, lang AS section, source AS relation FROM documents WHERE lang = 'en' AND source = 'src3' AND contains(lower(text), 'thor') ORDER BY doc_id LIMIT 20")
def rsn_retrieve(spark, d):
    """RSN-13, SRT-04, JON-15"""
    recs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("relation"), F.array().cast("array<string>").alias("terms"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("page"), F.lit("").alias("kif"), F.lit("").alias("cnl"), F.col("text").alias("original"))
    return K.retrieve(recs, section="en", relation="src3", text="thor", limit=20).select("record_id", "section", "relation")


# ---------------------------------------------------------------- joins, sets and audits


@query(f"SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, lower({squash('unnest(string_split(text, chr(10)))')}) AS k FROM documents) JOIN (SELECT item_id, lower({squash('text')}) AS k FROM benchmark) USING (k)")
def jon_leakage(spark, d):
    """JON-18, SET-02: benchmark texts that are lines of documents"""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc_id", X.text_key(F.col("raw")).alias("k"))
    return lines.join(table(spark, d, "benchmark").select("item_id", X.text_key(F.col("text")).alias("k")), "k").select("doc_id", "item_id").distinct()


@query(f"SELECT conv_id, turn, array_to_string(f, ',') AS found_in FROM (SELECT conv_id, turn, lower({squash('text')}) AS k FROM conversations) JOIN (SELECT k, list(DISTINCT lang ORDER BY lang) AS f FROM (SELECT lower({squash('text')}) AS k, 'benchmark' AS lang FROM benchmark UNION ALL SELECT lower({squash("unnest(string_split(text, chr(10)))")}), lang FROM documents) WHERE k <> '' GROUP BY k) USING (k)")
def jon_overlap(spark, d):
    """JON-04: turns that are a benchmark text or a line of a document, with what holds them"""
    known = table(spark, d, "benchmark").select("text", F.lit("benchmark").alias("source")).unionByName(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("text"), F.col("lang").alias("source")))
    return A.overlap(table(spark, d, "conversations").select("conv_id", "turn", "text"), known.where(X.squash(F.col("text")) != "")).select("conv_id", "turn", F.array_join("found_in", ",").alias("found_in"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'toxic' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'quality' END AS excluded_by FROM documents")
def jon_excluded(spark, d):
    """JON-05, JON-06, SET-07: anti joins with priority"""
    lab = table(spark, d, "labels")
    return A.excluded(table(spark, d, "documents").select("doc_id"), [("toxic", lab.where("toxic = 1")), ("quality", lab.where("quality = 0"))], "doc_id").select("doc_id", "excluded_by")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right' ELSE 'left' END AS only_in FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def jon_id_mismatch(spark, d):
    """JON-02, JON-12, SET-04, SET-06"""
    return A.id_mismatch(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT a.doc_id, a.v AS before, b.v AS after FROM (SELECT doc_id, quality AS v FROM labels) a JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS v FROM labels) b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v")
def jon_changed(spark, d):
    """JON-03"""
    lab = table(spark, d, "labels")
    return A.changed(lab.select("doc_id", F.col("quality").alias("v")), lab.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("v")), "doc_id", "v")


@query("WITH v AS (SELECT unnest(['thor', 'des', 'ist', 'en la']) AS phrase) SELECT c.conv_id, c.turn, v.phrase FROM conversations c, v WHERE contains(' ' || regexp_replace(lower(c.text), '\\s+', ' ', 'g') || ' ', ' ' || v.phrase || ' ')")
def jon_ngram_link(spark, d):
    """JON-08, RTE-18: n-grams meet a phrase index in an equi join"""
    index = spark.createDataFrame([(p,) for p in ("thor", "des", "ist", "en la")], "phrase string")
    toks = X.words(F.lower("text"))
    return S.spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.explode(X.ngrams(toks, 2)).alias("phrase")).join(F.broadcast(index), "phrase").select("conv_id", "turn", "phrase")  # four rows


@query("SELECT count_if(q AND NOT t) AS first_only, count_if(t AND NOT q) AS second_only, count_if(q AND t) AS both, count_if(NOT q AND NOT t) AS neither FROM (SELECT quality = 1 AS q, toxic = 1 AS t FROM labels)")
def agg_partition(spark, d):
    """AGG-08, SET-03"""
    return A.partition_verdict(table(spark, d, "labels").select((F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")), ["q", "t"])


RESULTS = "(SELECT doc_id, lang, doc_id % 7 <> 0 AS scored, CASE WHEN doc_id % 3 = 0 THEN 'accepted' WHEN doc_id % 3 = 1 THEN 'review' ELSE 'abstain' END AS route, quality = 1 AS expected, quality = 1 AND toxic = 0 AS exact, doc_id % 2 = 0 AS restated FROM labels JOIN documents USING (doc_id))"
EVAL = """count(*) AS total, count_if(scored) AS scored, count_if(scored AND route = 'accepted') AS accepted, count_if(scored AND route = 'accepted' AND exact) AS accepted_exact,
count_if(scored AND route = 'accepted' AND exact)::DOUBLE / nullif(count_if(scored AND route = 'accepted'), 0) AS precision, count_if(scored AND route = 'accepted')::DOUBLE / nullif(count_if(scored), 0) AS coverage,
count_if(scored AND route = 'accepted' AND exact)::DOUBLE / nullif(count_if(scored AND expected), 0) AS positive_coverage, count_if(scored AND NOT expected AND route = 'abstain')::DOUBLE / nullif(count_if(scored AND NOT expected), 0) AS abstention_accuracy,
count_if(scored AND NOT expected AND route = 'accepted') AS false_accepts, count_if(scored AND route = 'accepted' AND NOT restated) AS novel, count_if(scored AND route = 'accepted' AND NOT restated)::DOUBLE / nullif(count_if(scored), 0) AS novel_coverage,
count_if(route = 'review') AS review"""


@query(f"SELECT lang, {EVAL} FROM {RESULTS} GROUP BY lang")
def agg_evaluation(spark, d):
    """AGG-03, AGG-04, AGG-05, FLT-13"""
    i = F.col("doc_id")
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    r = r.select("lang", (i % 7 != 0).alias("scored"), F.when(i % 3 == 0, "accepted").when(i % 3 == 1, "review").otherwise("abstain").alias("route"), (F.col("quality") == 1).alias("expected"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("exact"), (i % 2 == 0).alias("restated"))
    return K.evaluation(r, ["lang"])


@query("SELECT lang, quality, count(*) AS n, count_if(toxic = 1) AS n_toxic, grouping(lang)::INT AS all_langs FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (quality))")
def agg_grouping_sets(spark, d):
    """AGG-10"""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupingSets([["lang", "quality"], ["quality"]], "lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.grouping("lang").cast("int").alias("all_langs"))


@query("SELECT avg(ok::INT)::DOUBLE AS pair_accuracy, count(*) AS pairs FROM (SELECT doc_id // 2 AS p, bool_and(quality = 1) AS ok FROM labels GROUP BY 1)")
def agg_pair_accuracy(spark, d):
    """AGG-11"""
    p = table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 2).alias("p")).agg(F.bool_and(F.col("quality") == 1).alias("ok"))
    return p.agg(F.avg(F.col("ok").cast("int")).alias("pair_accuracy"), F.count(F.lit(1)).alias("pairs"))


@query("SELECT source, doc_id, n_chars, rk::INT AS rk FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents) WHERE rk <= 3")
def srt_top(spark, d):
    """SRT-02, SRT-03, SRT-05, WIN-08"""
    from pyspark.sql import Window as W

    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rk")).where("rk <= 3")


@query("SELECT item_id, 'short' AS rule FROM benchmark WHERE length(text) < 120 UNION ALL SELECT item_id, 'several lines' FROM benchmark WHERE contains(text, chr(10)) UNION ALL SELECT item_id, 'odd id' FROM benchmark WHERE item_id % 2 = 1")
def val_violations(spark, d):
    """The form of all validators, with three rules of its own"""
    t = F.col("text")
    return A.violations(table(spark, d, "benchmark"), "item_id", {"short": F.length(t) < 120, "several lines": F.contains(t, F.lit("\n")), "odd id": F.col("item_id") % 2 == 1})


# ---------------------------------------------------------------- definitions, routing and artifacts


def _known(spark):
    return FX.frame(spark, FX.KNOWN, "term string")


@query(values(FX.DECLARED, ["id", "cnl", "passage", "evidence", "symbol", "alias", "cue", "reason"], "SELECT id, coalesce(reason, 'accepted') AS reason"))
def grd_declared(spark, d):
    """GRD-16 to GRD-28"""
    rows = FX.frame(spark, FX.DECLARED, "id int, cnl string, passage string, evidence string, symbol string, alias string, cue string, want string")
    return D.declared_gate(rows.withColumn("parents", F.split(F.lit(FX.PARENTS), ",")), _known(spark)).select("id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query(values(FX.PROPOSED, ["seq", "candidate", "evidence", "symbol", "genus_phrase", "parents", "kept"], "SELECT seq, symbol, genus_phrase, parents, kept") + " WHERE symbol IS NOT NULL")
def grd_proposed(spark, d):
    """GRD-29 to GRD-31, PRJ-27, SET-05"""
    rows = FX.frame(spark, [r[:3] for r in FX.PROPOSED], "seq int, candidate string, evidence string")
    got = D.proposals(rows, _known(spark)).where("symbol IS NOT NULL")
    return D.registry(D.parent_candidates(got, ["Process"], _known(spark))).select("seq", "symbol", "genus_phrase", F.array_join("parents", ",").alias("parents"), "kept")


@query(values(FX.ROUTED, ["id", "text", "template", "cnl"], "SELECT id, template, cnl"))
def rte_predictions(spark, d):
    """RTE-02 to RTE-21, SRT-10, JON-09"""
    rows = FX.frame(spark, [r[:2] for r in FX.ROUTED], "id int, text string")
    return R.predictions(rows, _known(spark), FX.frame(spark, FX.ROUTE_RELATIONS, "term string")).select("id", "template", "cnl")


def _memory(spark):
    return FX.frame(spark, FX.MEMORY, "statement_id string, child string, parent string, path string, line int")


@query(values(FX.RECALLED, ["id", "statement_id", "rank"], "SELECT id, statement_id, rank"))
def jon_recall(spark, d):
    """JON-10, SRT-02"""
    return D.recall_by_words(FX.frame(spark, FX.RECALL_SOURCES, "id string, text string"), _memory(spark)).select("id", "statement_id", "rank")


@query("SELECT * FROM (VALUES ('g1', 'm5', 1)) t(id, statement_id, rank)")
def jon_recall_genus(spark, d):
    """JON-11, SRT-03"""
    return D.recall_by_genus(FX.frame(spark, [("g1", "primary process"), ("g2", ""), ("g3", "kettle")], "id string, genus_phrase string"), _memory(spark)).select("id", "statement_id", "rank")


@query("SELECT 'axiom_' || (row_number() OVER (ORDER BY p_partkey) - 1) AS name, 'fof(axiom_' || (row_number() OVER (ORDER BY p_partkey) - 1) || ',axiom,(subclass(' || chr(39) || 'P' || p_partkey || chr(39) || ',' || chr(39) || 'S' || p_size || chr(39) || '))).' AS line, 'source' AS kind, 'r' || p_partkey AS record_id FROM part UNION ALL "
       + values([(n, f"fof({n},axiom,({f})).", "rule") for n, f in ART.RULES], ["name", "line", "kind"], "SELECT name, line, kind, NULL"))
def snk_theory(spark, d):
    """SNK-05, RSN-02, RSN-12, WIN-12"""
    key = F.col("p_partkey").cast("string")
    recs = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("r"), key).alias("record_id"), F.lit("source").alias("kind"), F.concat(F.lit("(subclass P"), key, F.lit(" S"), F.col("p_size").cast("string"), F.lit(")")).alias("kif"))
    return ART.theory(recs)


@query("SELECT p_partkey AS seq, ';;; r' || p_partkey || ' | page ' || p_size || ' | section ' || p_brand || chr(10) || '(instance P' || p_partkey || ' Part)' || chr(10) AS text FROM part")
def snk_bundle(spark, d):
    """SNK-03, SNK-04"""
    key = F.col("p_partkey").cast("string")
    return ART.bundle(table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("r"), key).alias("record_id"), F.col("p_size").alias("page"), F.col("p_brand").alias("section"), F.concat(F.lit("(instance P"), key, F.lit(" Part)")).alias("kif")))


# ---------------------------------------------------------------- candidate statements, background edges, the phrase baseline


def _prompts(spark):
    return FX.frame(spark, FX.PROMPTS, "id string, text string"), _known(spark), FX.frame(spark, FX.PROMPT_RELATIONS, "term string")


@query(values(FX.LANGUAGE, ["id", "cnl"], "SELECT id, cnl"))
def dec_language(spark, d):
    """DEC-01 to DEC-05, RTE-18"""
    rows, classes, relations = _prompts(spark)
    return N.language(rows.where("id IN ('p1', 'p2', 'p4', 'p5')"), classes, relations).select("id", "cnl")


@query(values([(i, c, int(w)) for i, c, w in FX.ADMITTED], ["id", "cnl", "admitted"], "SELECT id, cnl, admitted = 1 AS admitted"))
def dec_admitted(spark, d):
    """DEC-01, DEC-03, DEC-04"""
    rows, classes, relations = _prompts(spark)
    return N.admitted(rows.join(FX.frame(spark, [r[:2] for r in FX.ADMITTED], "id string, cnl string"), "id"), classes, relations).select("id", "cnl", "admitted")


@query(values([(r[0], c) for r in FX.CHILDREN for c in r[4].split("|") if c], ["id", "cnl"], "SELECT id, cnl"))
def dec_definition(spark, d):
    """DEC-06"""
    return N.definition_language(FX.frame(spark, [r[:4] for r in FX.CHILDREN], "id string, text string, child string, parents string").withColumn("parents", F.split("parents", ",")))


@query("SELECT * FROM (VALUES ('b1', '?x is-a Vessel'), ('b2', 'some ?x is-a Port')) t(id, cnl)")
def dec_best(spark, d):
    """DEC-08"""
    return N.best(FX.frame(spark, FX.SCORED, "id string, cnl string, logp double, n_tokens int"))


@query("SELECT * FROM (VALUES ('a1', 'Process', 'IntelligenceProduct'), ('a2', 'Process', 'Process')) t(id, raw_choice, calibrated_choice)")
def dec_parent_choice(spark, d):
    """DEC-11"""
    return N.parent_choice(FX.frame(spark, FX.PARENT_SCORES, "id string, seq int, parent string, raw double, empty double"))


@query("SELECT l_orderkey, l_linenumber, -l_discount < -l_tax AS veto FROM lineitem")
def dec_veto(spark, d):
    """DEC-12"""
    return N.vetoed(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_discount")).alias("logp_accept"), (-F.col("l_tax")).alias("logp_reject"))).select("l_orderkey", "l_linenumber", "veto")


@query("SELECT * FROM (VALUES (1, 0.75::DOUBLE), (2, 0.5), (3, NULL)) t(id, confidence)")
def dec_confidence(spark, d):
    """DEC-09"""
    return FX.frame(spark, [r[:2] for r in FX.LOGITS], "id int, logits array<array<double>>").select("id", N.confidence(F.col("logits")).alias("confidence"))


def _background(spark):
    return FX.frame(spark, FX.BACKGROUND, "child string, parent string")


@query(values([(i, c) for i, _, c in FX.IMPLIED if c], ["id", "cnl"], "SELECT id, cnl"))
def rte_implied(spark, d):
    """RTE-01"""
    return N.implied(FX.frame(spark, [r[:2] for r in FX.IMPLIED], "id string, text string"), _known(spark), _background(spark))


@query(values([(r[0], int(r[3])) for r in FX.LICENSED], ["id", "licensed"], "SELECT id, licensed = 1 AS licensed"))
def grd_licensed(spark, d):
    """GRD-14"""
    return N.licensed(FX.frame(spark, [r[:3] for r in FX.LICENSED], "id string, cnl string, text string"), _background(spark)).select("id", "licensed")


@query(values([(r[0], r[6]) for r in FX.STATED], ["id", "cnl"], "SELECT id, cnl"))
def rte_stated_parent(spark, d):
    """RTE-22"""
    rows = FX.frame(spark, [r[:6] for r in FX.STATED], "id string, passage string, alias string, cue string, symbol string, parents string")
    return D.stated_parent(rows.withColumns({"evidence": F.col("passage"), "parents": F.split("parents", ",")}), _known(spark))


@query(values([(r[0], r[7], r[8]) for r in FX.CLAIMS if r[7]], ["id", "cnl", "kif"], "SELECT id, cnl, kif"))
def arc_claims(spark, d):
    """ARC-02 to ARC-05"""
    rows = FX.frame(spark, [r[:7] for r in FX.CLAIMS], "id int, pattern string, subject string, predicate string, object string, quantifier string, negated boolean")
    return B.map_claims(rows, _known(spark), FX.frame(spark, FX.PROMPT_RELATIONS, "term string"), FX.frame(spark, [("sea bus", "Ferry")], "phrase string, term string"), FX.frame(spark, [("shows the way", "guides")], "phrase string, term string")).select("id", "cnl", "kif")


@query(values([(i, n) for i, _, n in FX.RESPONSES], ["id", "n"], "SELECT id, n"))
def arc_parse(spark, d):
    """ARC-01"""
    got = B.parse_claims(F.col("text"))
    return FX.frame(spark, [r[:2] for r in FX.RESPONSES], "id int, text string").select("id", F.when(got.isNotNull(), F.size(got)).alias("n"))


@query(values([(r[0], v) for r in FX.PACKET for v in r[15].split(",") if v], ["record_id", "rule"], "SELECT record_id, rule"))
def val_packet(spark, d):
    """VAL-02"""
    names = "record_id doc_id page source_span status reviewer_type reviewed_by decision abstention_reason coverage claim_text cnl kif compiled terms".split()
    rows = FX.frame(spark, [r[:15] for r in FX.PACKET], ", ".join(f"{n} string" for n in names)).withColumn("terms", F.split("terms", ","))
    return A.packet_violations(rows, FX.frame(spark, FX.PASSAGES, "record_id string, doc_id string, page string, excerpt string"), FX.frame(spark, FX.PAGES, "page string, text string"), FX.frame(spark, [("(subclass Tug Vessel)",)], "kif string"), ["deixis", "scope"])


@query(values([(r[2], v) for r in FX.REGISTRY for v in r[4].split(",") if v], ["symbol", "rule"], "SELECT symbol, rule"))
def val_registry(spark, d):
    """VAL-07"""
    return A.registry_violations(FX.frame(spark, [r[:4] for r in FX.REGISTRY], "alias string, evidence_cue string, symbol string, declaration string"), _known(spark))


@query("SELECT doc_id AS record_id, unnest(['source changed'] || CASE WHEN doc_id % 7 = 0 THEN ['span'] ELSE [] END) AS rule FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'span' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0")
def val_run(spark, d):
    """VAL-05: a run over all documents in which every fifth hash and every seventh span is wrong"""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text")
    sha = F.when(F.col("record_id") % 5 == 0, "stale").otherwise(F.sha2(F.encode("text", "UTF-8"), 256))
    span = F.when(F.col("record_id") % 7 == 0, F.concat(F.substring("text", 1, 4), F.lit("\u0000"))).otherwise(F.substring("text", 1, 4))
    runs = docs.select("record_id", sha.alias("source_sha256"), F.lit(0).alias("span_start"), F.least(F.length("text"), F.lit(4)).alias("span_end"), span.alias("span"), F.substring("text", 1, 3).alias("evidence"))
    return A.run_violations(runs, docs)


# ---------------------------------------------------------------- training pairs


def _said(templates: list[str]) -> str:
    """Wordings as an SQL list over columns term, s (in words) and an (with its article)."""
    cell = lambda t: "'" + t.replace("{1n}", "' || s || '").replace("{1a}", "' || an || '").replace("{1A}", "' || upper(an[1]) || an[2:] || '").replace("{1}", "' || term || '") + "'"
    return "[" + ", ".join(map(cell, templates)) + "]"


@query("WITH c AS (" + values(FX.CLASSES, ["seq", "term"], "SELECT *") + r"), n AS (SELECT term, lower(regexp_replace(regexp_replace(term, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')) AS s FROM c), a AS (SELECT term, s, CASE WHEN s[1] IN ('a','e','i','o','u') THEN 'an ' ELSE 'a ' END || s AS an FROM n) "
       + f"SELECT 'instance' AS pattern, unnest({_said(P.INSTANCE_WORDINGS)}) AS nl, '?x is-a ' || term AS cnl, '(instance ?x ' || term || ')' AS kif FROM a UNION ALL SELECT 'instance', 'A doc of it.', '?x is-a Port', '(instance ?x Port)' UNION ALL SELECT 'existential', unnest({_said(P.EXISTENTIAL_WORDINGS)}), 'some ?x is-a ' || term, '(exists (?x) (instance ?x ' || term || '))' FROM a "
       + f"UNION ALL SELECT 'negation', unnest({_said(P.DENIED_WORDINGS)}), 'not ?x is-a ' || term, '(not (instance ?x ' || term || '))' FROM a")
def gen_unary(spark, d):
    """GEN-01, GEN-08, GEN-09 (of instances)"""
    c = FX.frame(spark, FX.CLASSES, "seq int, term string").withColumn("doc", F.when(F.col("term") == "Port", "A doc of it."))
    return A.union_all([P.instance_pairs(c), P.existential_pairs(c), P.negation_pairs(c)])


@query("SELECT p_name AS child, parent FROM (SELECT p_name, lead(p_name) OVER (ORDER BY p_partkey) AS parent FROM part WHERE p_size % 3 <> 0) WHERE parent IS NOT NULL")
def gen_adjacent(spark, d):
    """GEN-02, WIN-05: the order has gaps"""
    return P.adjacent(table(spark, d, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("term")))


def _typed(spark):
    return FX.frame(spark, FX.RELATIONS, "term string, arity int").where("arity IS NOT NULL"), FX.frame(spark, FX.TYPED_SIGNATURE, "term string, position int, class string"), FX.frame(spark, FX.NARROWER, "wide string, narrow string")


@query("WITH v AS (SELECT unnest(['Vessel', 'Ferry', 'OreShip']) AS c) SELECT 'between' AS term, v.c AS a, 'Port' AS b, 'Entity' AS c FROM v")
def gen_typed(spark, d):
    """GEN-05, GEN-07, GEN-10, JON-13, JON-14"""
    rel, sig, narrow = _typed(spark)
    return P.typed(rel, sig, 3, narrow)


@query("SELECT DISTINCT n_name AS alias, t.parent AS stated_parent, upper(n_name[1]) || n_name[2:] || ' ' || t.tail AS sentence FROM nation, " + values(FX.VARIANTS, ["parent", "cue", "tail"], "(SELECT parent, tail") + ") t")
def gen_minimal_pairs(spark, d):
    """GEN-11, GEN-12"""
    return P.minimal_pairs(table(spark, d, "nation").select(F.col("n_name").alias("alias")), FX.frame(spark, FX.VARIANTS, "parent string, cue string, tail string")).select("alias", "stated_parent", "sentence")


@query("""WITH r AS (SELECT l_returnflag AS pattern, l_orderkey || '-' || l_linenumber AS nl, l_orderkey::VARCHAR AS cnl, l_linenumber AS n FROM lineitem WHERE l_orderkey % 10 <> 0),
k AS (SELECT pattern, nl, n = 7 AS fixed, row_number() OVER (PARTITION BY pattern ORDER BY (n <> 7)::INT, md5(nl || '|' || cnl)) AS rk FROM r) SELECT pattern, nl FROM k WHERE fixed OR rk <= 50""")
def gen_prepared(spark, d):
    """GEN-13, SET-06: order tenths are held out, seventh lines are pinned, 50 rows a pattern"""
    key = F.col("l_orderkey").cast("string")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("pattern"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("nl"), key.alias("cnl"), key.alias("kif"), "l_orderkey", "l_linenumber")
    return P.prepared(rows, rows.where("l_orderkey % 10 = 0"), rows.where("l_linenumber = 7"), 50).select("pattern", "nl")


@query()
def gen_compiled(spark, d):
    """GEN-02 to GEN-07, GEN-09 (of relations), FLT-08, VAL-04, AGG-01: every generated text compiles to its formula"""
    classes, relations = FX.frame(spark, FX.CLASSES, "seq int, term string"), FX.frame(spark, FX.RELATIONS, "term string, arity int")
    more = [P.edge_pairs(FX.frame(spark, [("Ferry", "Vessel")], "child string, parent string")), P.ternary_pairs(*_typed(spark)), P.if_pairs(*_typed(spark))]
    rows = A.union_all([P.relation_pairs(*_typed(spark)), P.subclass_pairs(P.adjacent(classes)), *more]).withColumnRenamed("kif", "want")
    return C.compile_cnl(rows, classes, relations).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kif") == F.col("want")).alias("n_same"))


@query("SELECT l_shipmode_key AS pattern, l_orderkey, l_linenumber FROM (SELECT l_returnflag AS l_shipmode_key, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(l_orderkey || '|' || l_linenumber)) AS n FROM lineitem) WHERE n <= 100")
def win_balanced(spark, d):
    """WIN-06, WIN-07"""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("pattern"), "l_orderkey", "l_linenumber")
    return P.balanced(rows, 100, order=[F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber"))])


@query("""WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(md5(o_orderpriority || '|' || o_orderstatus)) AS o FROM orders GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total, row_number() OVER (ORDER BY o) = count(*) OVER () AS last FROM g)
SELECT o_orderpriority, o_orderstatus, CASE WHEN before * 100 < total * 20 AND NOT last THEN 'validation' ELSE 'train' END AS split, n FROM s""")
def win_grouped_split(spark, d):
    """WIN-09"""
    key = ["o_orderpriority", "o_orderstatus"]
    got = P.grouped_split(table(spark, d, "orders").select(*key), 20, key=key, order=F.md5(F.concat_ws("|", *key)))
    return got.groupBy(*key, "split").agg(F.count(F.lit(1)).alias("n"))


from . import review_queries  # noqa: E402, F401  (its queries join the same registry)
