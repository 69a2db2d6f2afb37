"""Documents to sentences with provenance, and what windows over them give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out over all cores if they come in fewer parts than those, as from one small file; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sentences(pages: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, position, sentence) and the page's columns in keep: the sentences that pass the filters, numbered from 0 in each page."""
    parts = spread(pages.select(key, *keep, text)).select(key, *keep, F.posexplode(X.sentences(F.col(text))).alias("k", "sentence")).where(X.is_sentence(F.col("sentence")))
    return parts.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("k")) - 1).select(key, *keep, "position", "sentence")


def first_seen(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The first row of each value; positions were given before, so they have gaps. The minimum of the order decides, by partial aggregation."""
    cols = [c for c in rows.columns if c != value]
    return rows.groupBy(value).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*", value)


def blocks(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, section, block): a heading starts a section and a blank line ends a block; sections start anew on each page."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "raw")).withColumn("line", X.squash(F.col("raw")))
    head = (F.col("line") != "") & X.is_heading(F.col("line"))
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("head", head).withColumn("section", F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(w))
    return lines.withColumn("block", F.sum(((F.col("line") == "") | F.col("head")).cast("int")).over(w)).where((F.col("line") != "") & ~F.col("head")).select(key, "line_no", "line", "section", "block")


def with_context(turns: DataFrame, key: str, order: str, text: str, n: int = 3) -> DataFrame:
    """turns with context: the n texts before, oldest first."""
    return turns.withColumn("context", F.collect_list(text).over(W.partitionBy(key).orderBy(order).rowsBetween(-n, -1)))


def prompt(text, context):
    """The normaliser's prompt: numbered context, then the sentence."""
    told = F.transform(context, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(F.when(F.size(context) > 0, F.concat(F.lit("Context:\n"), F.array_join(told, "\n"), F.lit("\n"))).otherwise(F.lit("")), F.lit("Sentence: "), text)


def parse_response(response):
    """normalized and ambiguous lines of a response; nothing at all is ambiguous."""
    lines = F.filter(F.transform(F.split(response, "\n"), lambda x: X.squash(x)), lambda x: x != "")
    doubt = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit("ambiguous:")))
    good = F.filter(lines, lambda x: ~F.startswith(F.lower(x), F.lit("ambiguous:")))
    return {"normalized": good, "ambiguous": F.when(F.size(lines) == 0, F.array(F.lit("empty response"))).otherwise(doubt)}


def routed(rows: DataFrame, text: str = "sentence", *, squashed: bool = False) -> DataFrame:
    """rows with route: noise is rejected, unsupported sentences abstain, scoped ones go to review, the rest are candidates. squashed: the texts are squashed, as those of X.sentences()."""
    t = F.col(text)
    noise, no, scope = X.is_noise(t, squashed=squashed), X.unsupported(t, squashed=squashed), X.scoped(t)
    return rows.withColumn("route", F.when(noise, "reject").when(no, "abstain").when(scope, "review").otherwise("candidate"))


def spans(rows: DataFrame, key: str, *, text: str = "text", first: str = "first") -> DataFrame:
    """(key, n, start, end, sentence) with exact places, from 0 and without the end: the given first sentence, then pieces after . ! or ? and white space before a capital, abbreviations spared. No row for a passage that is NULL or does not begin with its first sentence."""
    split = rf"(?s).+?(?:(?<=[.!?])(?<!U\.S\.|U\.K\.|e\.g\.|i\.e\.){X.BLANK}+(?=[A-Z])|\z)"
    rest = F.substr(F.col(text), F.length(first) + 1)
    gap = F.regexp_extract(rest, rf"^{X.BLANK}*", 0)
    tail = F.substr(F.col(text), F.length(first) + F.length(gap) + 1)
    found = rows.where((F.col(first) != "") & F.startswith(text, first)).select(key, F.posexplode(F.concat(F.array(F.concat(first, gap)), F.regexp_extract_all(tail, F.lit(split), 0))).alias("n", "_raw"))
    before = F.coalesce(F.sum(F.length("_raw")).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    said = F.regexp_replace("_raw", rf"{X.BLANK}+$", "")
    return found.select(key, "n", before.cast("int").alias("start"), said.alias("sentence")).where("sentence <> ''").select(key, "n", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def screened(sentence_spans: DataFrame, key: str) -> DataFrame:
    """The spans of each passage up to and with the first whose definition head qualifies: (key, n, start, end, reason, subject, head); reason is NULL for that one alone."""
    head = X.definition_head(F.col("sentence"))
    rows = sentence_spans.select(key, "n", "start", "end", *[v.alias(k) for k, v in head.items()])
    chosen = F.min(F.when(F.col("reason").isNull(), F.col("n"))).over(W.partitionBy(key))
    return rows.withColumn("_n", chosen).where("_n IS NULL OR n <= _n").drop("_n")


#: What ends a numbered paragraph.
PARAGRAPH_STOPS = r"^(?:Chapter |SECTION |Figure \d|Table \d|[⚫•▪●])"


def numbered_paragraphs(pages: DataFrame, publication: str, *, key: str = "page_id", chapter: str = "chapter", text: str = "text") -> DataFrame:
    """(key, chapter, page, paragraph, excerpt, nl): paragraphs that a line like '2-14. ' opens, until the next one, a footer, a heading, a caption or a bullet; those with a first sentence. page is the number printed beside the publication in the last line that names it."""
    lines = pages.select(key, chapter, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_i", "_raw")).withColumn("_l", F.regexp_replace("_raw", rf"^{X.BLANK}+|{X.BLANK}+$", ""))
    mine = F.concat(F.lit("^("), F.col(chapter).cast("string"), F.lit(r"-\d+)\.\s+(.*)"))
    number, opened = F.regexp_substr("_l", F.concat(F.lit("^"), F.col(chapter).cast("string"), F.lit(r"-\d+(?=\.\s)"))), F.regexp_like("_l", mine)
    footer = F.contains("_l", F.lit(publication))
    capitals = (F.col("_l") == F.upper("_l")) & F.regexp_like("_l", F.lit(r"\p{Lu}")) & (F.length("_l") < 100)
    stop = (footer & F.regexp_like("_l", F.lit(r"\b20\d\d\b"))) | F.regexp_like("_l", F.lit(PARAGRAPH_STOPS)) | capitals
    w = W.partitionBy(key, chapter)
    run = F.sum((opened | stop).cast("int")).over(w.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    printed = F.regexp_substr(F.replace(F.max_by(F.when(footer, F.col("_l")), F.when(footer, F.col("_i"))).over(w), F.lit(publication), F.lit("")), F.concat(F.lit(r"\b"), F.col(chapter).cast("string"), F.lit(r"-\d+\b")))
    lines = lines.withColumn("_run", run).withColumn("page", printed).withColumn("_p", F.when(opened, number)).withColumn("_t", F.when(opened, F.regexp_replace("_l", r"^\d+-\d+\.\s+", "")).when(~stop & (F.col("_l") != ""), F.col("_l")))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_i", "_t")))), lambda x: x["_t"])
    got = lines.groupBy(key, chapter, "_run").agg(F.max("page").alias("page"), F.max("_p").alias("paragraph"), F.array_join(kept, " ").alias("excerpt")).where("paragraph IS NOT NULL")
    return got.withColumn("nl", X.first_sentence(F.col("excerpt"))).where("nl IS NOT NULL").select(key, chapter, "page", "paragraph", "excerpt", "nl")
