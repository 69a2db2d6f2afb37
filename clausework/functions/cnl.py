"""The controlled language: a recursive-descent parser, its formulas, and checks against a vocabulary.

sentence  := statement [ '.' ]
statement := 'not' atom | 'every' var 'is-a' term ['implies' statement] | 'some' var 'is-a' term
           | 'no' var 'is-a' term ['implies' statement] | 'if' statement 'and' statement ... 'then' statement | atom
atom      := arg 'is-a' term | term 'subclass-of' term | rel '[' arg ',' arg ... ']' | rel arg arg
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: The words of the language.
RESERVED = ("is-a", "subclass-of", "not", "every", "some", "no", "if", "and", "then", "implies")
_TOKEN = re.compile(r"//[^\n]*|(\?[a-z][A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9_]*(?:-[a-z]+)?|[\[\],.])|\s+|(.)")


class ParseError(ValueError):
    pass


@dataclass
class Formula:
    """An s-expression with what the checks need: atoms in order, and variables that no quantifier binds."""

    kif: str
    atoms: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    free: list[str] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str):
        self.tokens = []
        for m in _TOKEN.finditer(text):
            if m[2]:
                raise ParseError(f"unexpected {m[2]!r}")
            if m[1]:
                self.tokens.append(m[1])
        self.at = 0
        self.atoms: list[tuple[str, tuple[str, ...]]] = []
        self.free: list[str] = []

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if not got or want and got != want:
            raise ParseError(f"expected {want or 'a term'}, got {got or 'the end'}")
        self.at += 1
        return got

    def term(self, variable: bool = True) -> str:
        got = self.take()
        if got in RESERVED or not (got[0].isalpha() or variable and got[0] == "?"):
            raise ParseError(f"unexpected {got}")
        return got

    def var(self) -> str:
        got = self.take()
        if got[0] != "?":
            raise ParseError(f"expected a variable, got {got}")
        return got

    def use(self, args: tuple[str, ...], bound: frozenset) -> None:
        self.free += [a for a in args if a[0] == "?" and a not in bound and a not in self.free]

    def atom(self, bound: frozenset) -> str:
        first = self.term()
        if self.peek() in ("is-a", "subclass-of"):
            word = "instance" if self.take() == "is-a" else "subclass"
            args = (first, self.term())
        elif self.peek() == "[":
            self.take()
            got = [self.term()]
            while self.peek() == ",":
                self.take()
                got.append(self.term())
            self.take("]")
            if len(got) < 2:
                raise ParseError("a list has two arguments or more")
            word, args = first, tuple(got)
        else:
            word, args = first, (self.term(), self.term())
        if word[0] == "?":
            raise ParseError("a relation is no variable")
        self.atoms.append((word, args))
        self.use(args, bound)
        return f"({word} {' '.join(args)})"

    def statement(self, bound: frozenset = frozenset()) -> str:
        word = self.peek()
        if word == "not":
            self.take()
            return f"(not {self.atom(bound)})"
        if word in ("every", "some", "no"):
            self.take()
            v = self.var()
            self.take("is-a")
            c = self.term(False)
            self.atoms.append(("instance", (v, c)))
            inside = bound | {v}
            if word == "some":
                return f"(exists ({v}) (instance {v} {c}))"
            if self.peek() == "implies":
                self.take()
                body = self.statement(inside)
                return f"(forall ({v}) (=> (instance {v} {c}) {body if word == 'every' else f'(not {body})'}))"
            return f"(forall ({v}) (instance {v} {c}))" if word == "every" else f"(forall ({v}) (not (instance {v} {c})))"
        if word == "if":
            self.take()
            parts = [self.atom(bound)]
            while self.peek() == "and":
                self.take()
                parts.append(self.atom(bound))
            self.take("then")
            then = self.statement(bound)
            return f"(=> {parts[0] if len(parts) == 1 else '(and ' + ' '.join(parts) + ')'} {then})"
        return self.atom(bound)


def parse(text: str) -> Formula:
    """All sentences of a text, one formula a line."""
    p = _Parser(text)
    out = []
    while p.peek():
        out.append(p.statement())
        if p.peek() == ".":
            p.take()
    if not out:
        raise ParseError("empty")
    return Formula("\n".join(out), p.atoms, p.free)


_PARSED = "kif string, error string, relations array<string>, arities array<int>, classes array<string>, free_vars array<string>, arguments array<string>"


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        try:
            f = parse(t or "")
            rel = [(w, len(a)) for w, a in f.atoms if w not in ("instance", "subclass")]
            classes = [x for w, a in f.atoms for k, x in enumerate(a) if x[0] != "?" and (w == "subclass" or w == "instance" and k == 1)]
            rows.append((f.kif, None, [r for r, _ in rel], [n for _, n in rel], list(dict.fromkeys(classes)), f.free, [" ".join((w, str(k), x)) for w, a in f.atoms if w not in ("instance", "subclass") for k, x in enumerate(a, 1)]))
        except ParseError as e:
            rows.append((None, f"syntax: {e}", [], [], [], [], []))
    return pd.DataFrame(rows, columns=["kif", "error", "relations", "arities", "classes", "free_vars", "arguments"])


def compile_cnl(rows: DataFrame, classes: DataFrame, relations: DataFrame, *, cnl: str = "cnl", closed: bool = False, kinds: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """rows with kif and error. Each distinct text is parsed once; terms meet the vocabulary (classes: term; relations: term, arity) in joins.

    The first of: syntax, unknown class, unknown relation, wrong arity (unless unknown), if kinds (term, position, kind) are
    given, an argument without a kind, a class where an instance is asked or a variable where a class is, and, if closed, a
    free variable. declared (term): further classes.
    """
    classes = classes.select("term") if declared is None else classes.select("term").union(declared.select("term")).distinct()
    parsed = rows.select(F.col(cnl).alias("_c")).distinct().withColumn("p", pandas_udf(_parse, _PARSED)("_c")).select("_c", "p.*")
    used = parsed.select("_c", F.explode("classes").alias("term")).join(classes.select("term"), "term", "left_anti").groupBy("_c").agg(F.min("term").alias("bad_class"))
    rel = parsed.select("_c", F.explode(F.arrays_zip("relations", "arities")).alias("r")).select("_c", F.col("r.relations").alias("term"), F.col("r.arities").alias("n"))
    rel = rel.join(relations.select("term", "arity", F.lit(True).alias("known")), "term", "left")
    faults = rel.groupBy("_c").agg(F.min(F.when(F.col("known").isNull(), F.col("term"))).alias("bad_rel"), F.min(F.when(F.col("known") & (F.col("arity") != F.col("n")), F.concat_ws("/", "term", "n"))).alias("bad_arity"))
    out = parsed.join(used, "_c", "left").join(faults, "_c", "left")
    if kinds is not None:
        args = parsed.select("_c", F.posexplode("arguments").alias("k", "a")).select("_c", "k", F.split("a", " ").alias("a"))
        args = args.select("_c", "k", F.col("a")[0].alias("term"), F.col("a")[1].cast("int").alias("position"), F.col("a")[2].alias("x")).join(kinds.select("term", "position", "kind"), ["term", "position"], "left")
        free = F.startswith("x", F.lit("?"))
        wrong = F.when(F.col("kind").isNull(), "no kind").when((F.col("kind") == "instance") & ~free, "class for an instance").when((F.col("kind") == "subclass") & free, "variable for a class")
        args = args.withColumn("_w", wrong).where("_w IS NOT NULL").groupBy("_c").agg(F.min_by(F.concat(F.col("_w"), F.lit(": "), F.concat_ws("/", "term", "position")), "k").alias("bad_kind"))
        out = out.join(args, "_c", "left")
    else:
        out = out.withColumn("bad_kind", F.lit(None).cast("string"))
    error = F.coalesce(
        "error", F.concat(F.lit("unknown class: "), "bad_class"), F.concat(F.lit("unknown relation: "), "bad_rel"), F.concat(F.lit("arity: "), "bad_arity"), F.concat(F.lit("argument kind: "), "bad_kind"),
        F.when((F.size("free_vars") > 0) & F.lit(closed), F.concat(F.lit("free variable: "), F.element_at("free_vars", 1))))
    out = out.select("_c", error.alias("error"), F.when(error.isNull(), F.col("kif")).alias("kif"))
    return rows.join(out, rows[cnl].eqNullSafe(out["_c"]), "left").drop("_c")


def error_kind(error: Column) -> Column:
    return F.when(error.isNull(), "valid").otherwise(F.split(error, ":")[0])


def cnl_terms(cnl: Column) -> Column:
    """Words of a CNL text that are neither reserved nor variables, distinct, in order."""
    got = F.regexp_extract_all(F.regexp_replace(cnl, "//[^\n]*", ""), F.lit(r"\??[A-Za-z][A-Za-z0-9_]*(?:-[a-z]+)?"), 0)
    return F.array_distinct(F.filter(got, lambda w: ~w.isin(*RESERVED) & ~F.startswith(w, F.lit("?"))))


def classify(cnl: Column) -> Column:
    """The pattern of a CNL text. A negated subclass statement is a negation here, so a positive source never licenses it."""
    c = F.trim(cnl)
    return (
        F.when(F.regexp_like(c, F.lit("^not ")), "negation").when(F.regexp_like(c, F.lit(r"^some \?")), "existential").when(F.regexp_like(c, F.lit(r"^\?[A-Za-z_][A-Za-z0-9_]*\s+is-a\s+")), "instance")
        .when(F.contains(c, F.lit(" subclass-of ")), "subclass").when(F.regexp_like(c, F.lit("^(every|if|no) ")), "conditional").when(F.regexp_like(c, F.lit(r"\[.*\]")), "nary").otherwise("relation")
    )


def ground_literal(kif: Column) -> dict[str, Column]:
    """relation, left, right and negative of a ground literal; relation NULL for anything else."""
    p = r"^\s*\((subclass|instance) ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)\s*$"
    n = r"^\s*\(not \((subclass|instance) ([A-Za-z][A-Za-z0-9_]*) ([A-Za-z][A-Za-z0-9_]*)\)\)\s*$"
    negative = F.regexp_like(kif, F.lit(n))
    pick = lambda k: F.nullif(F.when(negative, F.regexp_extract(kif, n, k)).otherwise(F.regexp_extract(kif, p, k)), F.lit(""))
    return {"relation": pick(1), "left": pick(2), "right": pick(3), "negative": negative}
