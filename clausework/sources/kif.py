"""KIF text: edges, asserted pairs, relation signatures and documentation. Lines carry their file and number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..plans.lineage import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of each line of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("k", "text")).select("file", (F.col("k") + 1).alias("line"), "text")


def edges(lines: DataFrame) -> DataFrame:
    """Subclass edges that begin a line: (child, parent, file, line). Comments and nested forms do not count."""
    p = r"^\(subclass ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)"
    return lines.select(F.regexp_extract("text", p, 1).alias("child"), F.regexp_extract("text", p, 2).alias("parent"), "file", "line").where("child <> ''")


def last_parent(edge: DataFrame) -> DataFrame:
    """One parent for each child: the last stated."""
    return edge.groupBy("child").agg(F.max_by("parent", F.struct("file", "line")).alias("parent"))


def asserted_pairs(lines: DataFrame) -> DataFrame:
    """Distinct (child, parent) anywhere before a comment sign."""
    live = F.split_part("text", F.lit(";"), F.lit(1))
    hits = F.regexp_extract_all(live, F.lit(r"\(subclass [A-Za-z][A-Za-z0-9_]* [A-Za-z][A-Za-z0-9_]*\)"), 0)
    return lines.select(F.explode(hits).alias("h")).select(F.split("h", "[ ()]+")[2].alias("child"), F.split("h", "[ ()]+")[3].alias("parent")).distinct()


_NAME = "[A-Za-z0-9_-]*"


def statements(lines: DataFrame) -> DataFrame:
    """(form, term, position, class, file, line) of statements that begin a line, blanks inside aside: subclass, instance, domain, range, domainSubclass, rangeSubclass, subrelation, and `type` for an instance statement that declares a relation. Position 0 is the range."""
    upper, lower = f"([A-Z]{_NAME})", f"([a-z]{_NAME})"
    forms = {
        "subclass": (rf"subclass\s+{upper}\s+()?{upper}"), "instance": rf"instance\s+{upper}\s+()?{upper}", "type": rf"instance\s+{lower}\s+()?([A-Z]{_NAME}(?:Predicate|Relation|Function){_NAME})",
        "domain": rf"domain\s+{lower}\s+([0-9]+)\s+{upper}", "domainSubclass": rf"domainSubclass\s+{lower}\s+([0-9]+)\s+{upper}", "range": rf"range\s+{lower}\s+()?{upper}", "rangeSubclass": rf"rangeSubclass\s+{lower}\s+()?{upper}",
        "subrelation": rf"subrelation\s+{lower}\s+()?([A-Za-z]{_NAME})",
    }
    found = [F.struct(F.lit(f).alias("form"), *[F.regexp_extract("text", rf"^\s*\(\s*{p}\s*\)", k).alias(n) for k, n in ((1, "term"), (2, "position"), (3, "class"))]) for f, p in forms.items()]
    got = lines.select("file", "line", F.explode(F.array(*found)).alias("s")).where("s.term <> ''")
    return got.select("s.form", "s.term", F.when(F.col("s.position") != "", F.col("s.position").cast("int")).when(F.startswith("s.form", F.lit("range")), 0).alias("position"), "s.class", "file", "line")


def signatures(lines: DataFrame) -> DataFrame:
    """(term, position, class, kind) of domain and range (position 0) statements. A later `domain` or `range`, by file and line, wins over an earlier one; their `Subclass` forms only fill gaps, the first of them."""
    got = statements(lines).where("form IN ('domain', 'domainSubclass', 'range', 'rangeSubclass')").withColumn("sure", F.col("form").isin("domain", "range"))
    sure, gap = F.max_by(F.when(F.col("sure"), F.col("class")), F.when(F.col("sure"), F.struct("file", "line"))), F.min_by(F.when(~F.col("sure"), F.col("class")), F.when(~F.col("sure"), F.struct("file", "line")))
    return got.groupBy("term", "position").agg(F.coalesce(sure, gap).alias("class"), F.when(F.bool_or("sure"), "instance").otherwise("subclass").alias("kind"))


def class_terms(lines: DataFrame) -> DataFrame:
    """Classes: both sides of subclass statements, and what is an instance of a class and written in capitals."""
    s = statements(lines)
    return s.where("form = 'subclass'").select(F.explode(F.array("term", "class")).alias("term")).union(s.where("form = 'instance'").select("term")).distinct()


def relation_terms(lines: DataFrame) -> DataFrame:
    """(term, type, arity): relations of any statement; the first type declared; the largest argument number, or that of the nearest parent relation, or NULL."""
    s = statements(lines).where("form NOT IN ('subclass', 'instance')")
    rel = s.groupBy("term").agg(F.min_by(F.when(F.col("form") == "type", F.col("class")), F.when(F.col("form") == "type", F.struct("file", "line"))).alias("type"), F.max(F.when(F.col("position") > 0, F.col("position"))).alias("arity"))
    up = s.where("form = 'subrelation'").groupBy("term").agg(F.max_by("class", F.struct("file", "line")).alias("parent"))
    arity = inherited_arities(rel.select("term", "arity"), up.select(F.col("term").alias("child"), "parent"))
    return rel.drop("arity").join(arity, "term")


def arities(sig: DataFrame) -> DataFrame:
    """term and arity: the largest argument number."""
    return sig.where("position > 0").groupBy("term").agg(F.max("position").alias("arity"))


def inherited_arities(arity: DataFrame, parents: DataFrame) -> DataFrame:
    """(term, arity): terms without an arity take that of the nearest parent relation (child, parent) that has one; NULL if none has. Smallest on a tie."""
    terms = arity.select("term").unionByName(parents.select(F.col("child").alias("term"))).unionByName(parents.select(F.col("parent").alias("term"))).distinct()
    known = terms.join(arity, "term", "left")
    while True:
        up = parents.join(known.where("arity IS NOT NULL").select(F.col("term").alias("parent"), F.col("arity").alias("a")), "parent").groupBy(F.col("child").alias("term")).agg(F.min("a").alias("a"))
        nxt = cut(known.join(up, "term", "left").select("term", F.coalesce("arity", "a").alias("arity")))
        if nxt.where("arity IS NOT NULL").count() == known.where("arity IS NOT NULL").count():
            return nxt
        known = nxt


def documentation(lines: DataFrame) -> DataFrame:
    """term and the first doc stated for it."""
    p = r'^\(documentation ([A-Za-z][A-Za-z0-9_]*) EnglishLanguage "([^"]*)"\)'
    got = lines.select(F.regexp_extract("text", p, 1).alias("term"), F.regexp_extract("text", p, 2).alias("doc"), "file", "line").where("term <> ''")
    return got.groupBy("term").agg(F.min_by("doc", F.struct("file", "line")).alias("doc"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


SENTENCES = T.StructType([T.StructField("sentence", T.StringType(), False), T.StructField("page_number", T.IntegerType(), False), T.StructField("position", T.IntegerType(), False), T.StructField("section", T.StringType())])


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence JSON lines; a row without a required field stops the read."""
    got = spark.read.schema(SENTENCES).option("mode", "FAILFAST").json(path)
    needed = [F.col(c).isNull() for c in ("sentence", "page_number", "position")]
    return got.where(~F.assert_true(~(needed[0] | needed[1] | needed[2]), "a required field is missing").isNotNull())


def write_routes(rows: DataFrame, path: str) -> None:
    """Accepted, review and reject rows, a folder each."""
    rows.write.mode("errorifexists").partitionBy("route").json(path)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file, line ends made canonical."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2(F.replace(F.decode("content", F.lit("UTF-8")), F.lit("\r\n"), F.lit("\n")), 256).alias("sha256"))
