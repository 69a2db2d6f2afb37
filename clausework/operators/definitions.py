"""Definitions of new terms: the genus a sentence states, proposals, their registry, the gate, and memory for the encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lineage import cut

#: Words and phrases of the definition rules.
GENUS_BOUNDARY = (
    "of that which who whose whereby where when used to for in on at by within with from designed derived produced performed conducted tasked intended responsible "
    "through between among than as it they we he she is are was were be has have provides provide can may will most more less least"
).split()
NON_DEFINIENDUM_STARTS = "this these that those there it they what while another such both all certain each many some other one following".split()
NON_KIND_HEADS = "application division part subset one type kind form combination group set component aspect portion example member means way goal result focus characteristic contribution ability key".split()
COORDINATORS = ("and", "or", "nor", "but")
GENERIC_WORDS = ("a", "an", "the", "is", "are", "of", "and", "to", "intelligence", "product", "process", "military", "information")
#: parent, its genus phrase, and the wording that must follow where the phrase has several senses.
GENUS_PHRASES = [("Process", "process", None), ("IntelligenceProduct", "intelligence product", None), ("IntelligenceProduct", "intelligence", r"intelligence\s+(that|which)\s+(is|are)\s+produced\b")]


def plain(text: Column) -> Column:
    """Lower words of letters and digits between single blanks; PascalCase is taken apart."""
    return F.trim(F.regexp_replace(X.spaced(F.replace(text, F.lit("_"), F.lit(" "))), "[^a-z0-9]+", " "))


def pascal(phrase: Column) -> Column:
    """PascalCase with only first letters in capitals."""
    return X.pascal(F.lower(phrase))


def genus(predicate: Column) -> dict[str, Column]:
    """article, phrase (tokens up to a boundary word; the last is the head) and tokens of a plain copular predicate."""
    article = F.regexp_like(predicate, F.lit("^(a|an|the)( |$)"))
    kind = F.regexp_replace(F.regexp_replace(predicate, "^(a|an|the)( |$)", ""), "^(type|kind|form) of( |$)", "")
    tokens = X.words(kind)
    stop = F.array_position(F.transform(tokens, lambda t: t.isin(*GENUS_BOUNDARY)), True)
    return {"article": article, "phrase": F.when(stop > 0, F.slice(tokens, 1, (stop - 1).cast("int"))).otherwise(tokens), "tokens": tokens}


def after_subject(sentence: Column, alias: Column) -> Column:
    """What follows the alias at the start of a plain sentence, an article before it allowed; NULL if it is not there."""
    bare = F.regexp_replace(sentence, "^(a|an|the) ", "")
    rest = lambda s: F.when(F.startswith(s, F.concat(alias, F.lit(" "))), F.substr(s, F.length(alias) + 2))
    return F.coalesce(rest(bare), rest(sentence))


def _same_noun(word: Column, noun: Column) -> Column:
    """word is noun or its regular plural."""
    plural = (
        F.when(F.regexp_like(noun, F.lit("[^aeiou]y$")), F.regexp_replace(noun, "y$", "ies"))
        .when(F.regexp_like(noun, F.lit("(s|x|z|ch|sh)$")), F.concat(noun, F.lit("es"))).otherwise(F.concat(noun, F.lit("s")))
    )
    return (word == noun) | (word == plural)


def is_tail(phrase: Column, parent: Column, whole: bool) -> Column:
    """Whether the tokens of parent end the genus phrase (whole: are all of it); never in a coordinated phrase."""
    n, m = F.size(phrase), F.size(parent)
    fits = (n > 0) & (m > 0) & ((n == m) if whole else (n >= m)) & ~F.arrays_overlap(phrase, F.array(*[F.lit(c) for c in COORDINATORS]))
    front = lambda a, start: F.slice(a, start, m - 1)
    return F.when(fits, (front(phrase, n - m + 1) == front(parent, F.lit(1))) & _same_noun(F.element_at(phrase, -1), F.element_at(parent, -1))).otherwise(F.lit(False))


def declared_gate(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (cnl, passage, evidence, symbol, alias, cue, parents) with reason (NULL: accepted), by the current passage only."""
    form = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s+subclass-of\s+([A-Za-z][A-Za-z0-9_]*)\s*\.?\s*$"
    known = classes.select(F.col("term").alias("_parent"), F.lit(True).alias("_known")).distinct()
    rows = rows.withColumns({"_child": F.regexp_extract("cnl", form, 1), "_parent": F.regexp_extract("cnl", form, 2)}).join(known, "_parent", "left")
    rows = rows.withColumns({"_alias": plain(F.col("alias")), "_after": after_subject(plain(F.col("evidence")), plain(F.col("alias")))})
    rows = rows.withColumn("_g", F.struct(*[c.alias(k) for k, c in genus(F.regexp_replace("_after", "^(is|are) ", "")).items()]))
    phrase, tokens, parent, child, symbol = F.col("_g.phrase"), F.col("_g.tokens"), F.col("_parent"), F.col("_child"), F.col("symbol")
    reviewed = parent.isin(*{p for p, _, _ in GENUS_PHRASES})
    stated = ~reviewed & F.col("_g.article") & is_tail(phrase, X.words(plain(parent)), True)
    unsure = F.lit(False)
    for name, said, cue in GENUS_PHRASES:
        words = said.split()
        hit = (parent == name) & is_tail(phrase, F.array(*map(F.lit, words)), False)
        rest = F.array_join(F.slice(tokens, F.greatest(F.size(phrase) - len(words) + 1, F.lit(1)), F.size(tokens)), " ")
        follows = F.regexp_like(rest, F.lit(f"^{cue}")) if cue else F.lit(True)
        stated, unsure = stated | (hit & follows), unsure | (hit & ~follows)
    stem = pascal(F.col("alias"))
    qualifier = F.when(F.startswith(symbol, stem), F.substr(symbol, F.length(stem) + 1))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(""))
    fits = F.coalesce((qualifier == "") | (qualifier == pascal(last(phrase))) | (qualifier == last(F.regexp_extract_all(parent, F.lit("[A-Z][a-z0-9]*|[a-z0-9]+"), 0))), F.lit(False))
    reason = (
        F.when(F.coalesce(child, F.lit("")) == "", "not_single_subclass").when((child != symbol) & (parent == symbol), "reversed_direction").when(child != symbol, "undeclared_child")
        .when((parent == symbol) | F.col("_known").isNull() | ~F.coalesce(F.array_contains("parents", parent), F.lit(False)), "parent_not_existing_class")
        .when((F.coalesce("evidence", F.lit("")) == "") | ~F.coalesce(F.contains("passage", "evidence"), F.lit(False)), "evidence_not_in_passage")
        .when(~F.coalesce(F.regexp_like("_after", F.lit("^(is|are) ")), F.lit(False)), "declaration_phrase_not_subject")
        .when(~F.coalesce(F.startswith(F.concat("_after", F.lit(" ")), F.concat(plain(F.col("cue")), F.lit(" "))), F.lit(False)), "declaration_sense_not_in_passage")
        .when(stated & ~fits, "symbol_sense_mismatch").when(~stated & unsure, "ambiguous_genus_sense").when(~stated, "unstated_parent").when(X.scoped(F.col("evidence")), "unverified_scope")
    )
    return rows.withColumn("reason", reason).drop("_parent", "_child", "_known", "_alias", "_after", "_g")


def stated_parent(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, cnl) for rows (id, passage, evidence, symbol, alias, cue, parents): the one offered parent that the gate accepts; NULL if none or several pass."""
    tried = rows.withColumn("cnl", F.explode(F.transform("parents", lambda p: F.concat(F.col("symbol"), F.lit(" subclass-of "), p))))
    passed = declared_gate(tried, classes).where("reason IS NULL").groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("cnl").alias("_c"))
    return rows.select("id").join(passed, "id", "left").select("id", F.when(F.col("_n") == 1, F.col("_c")).alias("cnl"))


def proposals(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (candidate, evidence) with alias, cue, symbol and genus_phrase of a new class; all NULL where declined."""
    frame = r"^(?i)(.+?)\s+(is|are)\s+(?:(a|an|the)\s+)?([A-Za-z][A-Za-z'-]*)$"
    said = X.squash(F.col("candidate"))
    alias = F.regexp_replace(F.regexp_extract(said, frame, 1), r"^(?i)(a|an|the)\s+", "")
    copula, article = F.regexp_extract(said, frame, 2), F.regexp_extract(said, frame, 3)
    rows = rows.withColumns({"_alias": alias, "_cue": F.trim(F.concat_ws(" ", copula, article))})
    rows = rows.withColumn("_after", after_subject(plain(F.col("evidence")), plain(F.col("_alias"))))
    rows = rows.withColumn("_g", F.struct(*[c.alias(k) for k, c in genus(F.regexp_replace("_after", "^(is|are) ", "")).items()]))
    phrase = F.col("_g.phrase")
    head = F.when(F.size(phrase) > 0, F.element_at(phrase, -1)).otherwise(F.lit(""))
    stem, suffix = pascal(F.col("_alias")), pascal(head)
    rows = rows.withColumns({"_stem": stem, "_symbol": F.when(F.endswith(stem, suffix), stem).otherwise(F.concat(stem, suffix))})
    heads = (head, F.regexp_replace(head, "s$", ""))
    sound = (
        (F.col("_alias") != "") & ~F.lower(F.split("_alias", r"\s+")[0]).isin(*NON_DEFINIENDUM_STARTS) & F.coalesce(F.regexp_like("_after", F.lit("^(is|are) ")), F.lit(False)) & F.col("_g.article")
        & ~F.arrays_overlap(phrase, F.array(*map(F.lit, COORDINATORS))) & ~heads[0].isin(*NON_KIND_HEADS) & ~heads[1].isin(*NON_KIND_HEADS) & F.regexp_like(head, F.lit("^[a-z]{3,}$")) & F.regexp_like("_symbol", F.lit("^[A-Z][A-Za-z0-9]*$"))
    )
    taken = classes.select("term").distinct()
    rows = rows.join(taken.select(F.col("term").alias("_symbol"), F.lit(True).alias("_t1")), "_symbol", "left").join(taken.select(F.col("term").alias("_stem"), F.lit(True).alias("_t2")), "_stem", "left")
    ok = F.coalesce(sound, F.lit(False)) & F.col("_t1").isNull() & F.col("_t2").isNull()
    out = {"alias": F.col("_alias"), "cue": F.col("_cue"), "symbol": F.col("_symbol"), "genus_phrase": F.array_join(phrase, " ")}
    return rows.withColumns({k: F.when(ok, c) for k, c in out.items()}).drop("_alias", "_cue", "_after", "_g", "_stem", "_symbol", "_t1", "_t2")


def parent_candidates(proposed: DataFrame, pool: list[str], classes: DataFrame) -> DataFrame:
    """proposed with parents: the pool, then classes that the genus phrase or its head names, distinct, in order."""
    known = classes.select("term").distinct()
    at = lambda k: known.select(F.col("term").alias(k), F.col("term").alias(f"{k}_known"))
    rows = proposed.withColumns({"_whole": pascal(F.col("genus_phrase")), "_head": pascal(F.regexp_extract("genus_phrase", r"([^ ]+)$", 1))})
    rows = rows.join(at("_whole"), "_whole", "left").join(at("_head"), "_head", "left")
    offered = F.array_distinct(F.array_compact(F.concat(F.array(*map(F.lit, pool)), F.array("_whole_known", "_head_known"))))
    return rows.withColumn("parents", offered).drop("_whole", "_head", "_whole_known", "_head_known")


def registry(proposed: DataFrame) -> DataFrame:
    """proposed (seq, alias, symbol) with kept: going by seq, one is kept if no kept one before it has its alias or symbol.

    Each round settles every row that comes first among the open rows of its alias and of its symbol; rows that share
    either with it go. So the rounds follow the longest chain of clashes, not the number of rows.
    """
    todo = cut(proposed.select("seq", F.lower("alias").alias("a"), F.col("symbol").alias("s")))
    kept = None
    while not todo.isEmpty():
        first = lambda k: todo.groupBy(k).agg(F.min("seq").alias(f"first_{k}"))  # noqa: E731, B023
        won = cut(todo.join(first("a"), "a").join(first("s"), "s").where("seq = first_a AND seq = first_s").select("seq", "a", "s"))
        kept = won.select("seq") if kept is None else kept.union(won.select("seq"))
        todo = cut(todo.join(won.select("a"), "a", "left_anti").join(won.select("s"), "s", "left_anti"))
    if kept is None:
        return proposed.withColumn("kept", F.lit(False))
    return proposed.join(kept.withColumn("kept", F.lit(True)), "seq", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def recall_by_words(sources: DataFrame, statements: DataFrame, limit: int = 2) -> DataFrame:
    """(id, statement_id, rank): the best statements (statement_id, child, line) for each source (id, text) by words shared with the child's name.

    Generic words count in the overlap but do not make a match. Ties go to fewer missing words, then to the earlier line.
    """
    bag = lambda c: F.array_distinct(F.regexp_extract_all(X.spaced(c), F.lit("[a-z0-9]+"), 0))
    specific = lambda a: F.filter(a, lambda w: ~w.isin(*GENERIC_WORDS))
    s = sources.select("id", bag(F.col("text")).alias("sw"))
    m = statements.select("statement_id", "line", bag(F.col("child")).alias("cw"))
    met = s.select("id", "sw", F.explode(specific(F.col("sw"))).alias("w")).join(m.select("statement_id", "line", "cw", F.explode(specific(F.col("cw"))).alias("w")), "w")
    # A pair meets once for each specific word that both have; the first of them in the child's name stands for the pair.
    met = met.where(F.col("w") == F.element_at(specific(F.array_intersect("cw", "sw")), 1))
    order = [F.desc(F.size(F.array_intersect("sw", "cw"))), F.size(F.array_except("cw", "sw")), F.col("line")]
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= limit).select("id", "statement_id", "rank")


def recall_by_genus(sources: DataFrame, statements: DataFrame, limit: int = 1) -> DataFrame:
    """(id, statement_id, rank): the first statements (statement_id, parent, path, line) whose parent's last word heads the genus phrase of (id, genus_phrase)."""
    m = statements.select("statement_id", F.element_at(F.split(X.spaced(F.col("parent")), " "), -1).alias("head"), "path", "line")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy("path", "line"))).where(F.col("rank") <= limit)
    return sources.where("genus_phrase <> ''").select("id", F.element_at(F.split("genus_phrase", " "), -1).alias("head")).join(m, "head").select("id", "statement_id", "rank")
