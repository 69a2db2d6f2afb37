"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits for letters, invisible signs), an Aho-Corasick automaton finds lexicon
stems at word starts, hits inside exception phrases do not count, and a logistic function of the weighted hits, each
normalised by the text's length in words, is the score. Stems, weights and further exceptions are learned from labelled rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import forget, packed, written

#: Look-alikes of Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "ı": "i", "ł": "l", "ø": "o",
    "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases of whole words in which a stem is harmless. Learned ones of two words are added.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish")

_GLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_GLYPH_TABLE = str.maketrans(HOMOGLYPHS)
_DIGIT = re.compile(r"(?<=[^\W\d_])[0-9@$!]+(?=[^\W\d_])|\b[0-9@$]+(?=[^\W\d_])")
_DIGIT_TABLE = str.maketrans(DIGITS)
_FULL = re.compile("[！-～]")
_WORD = re.compile(r"[^\W\d_]+")
#: A stem is the first letters of a word, so many of them.
STEM_LENGTHS = range(3, 65)
#: A stem is learned if the lower end of its log odds (so many standard errors down) is over LEAST_ODDS and MIN_DOCS toxic texts have it.
ERRORS, LEAST_ODDS, MIN_DOCS = 1.64, 0.5, 2


def fold(text: str | None) -> str:
    """Lower case, look-alikes to Latin letters, full-width to plain, and digits and signs between letters to letters. Null: empty."""
    t = (text or "").lower()
    if not t.isascii():
        t = _FULL.sub(lambda m: chr(ord(m[0]) - 0xFEE0), t) if _FULL.search(t) else t
        t = t.translate(_GLYPH_TABLE) if _GLYPH.search(t) else t
    return _DIGIT.sub(lambda m: m[0].translate(_DIGIT_TABLE), t)


def n_words(text: str) -> int:
    return text.count(" ") + text.count("\n") + 1


@dataclass
class Lexicon:
    """Stems with weights, the bias, and exception phrases. It is fitted once and shipped with each task; its size is bounded by the labelled rows that it is learned from."""

    stems: list[str]
    weights: list[float]
    bias: float
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        at: dict[str, list[int]] = {}
        for k, s in enumerate(self.stems):
            at[s] = [k, 0]
        for e in self.exceptions:
            at.setdefault(e, [-1, 0])[1] = 1
        a = ahocorasick.Automaton()
        for s, (k, spares) in at.items():
            a.add_word(s, (k, spares, len(s)))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, a, folded: str) -> dict[int, int]:
        """Stem number to count: all stems at each word start, outside of exception phrases, which must end where a word ends."""
        if not len(a):
            return {}
        found: list[tuple[int, int]] = []
        spared: list[tuple[int, int]] = []
        size = len(folded)
        for end, (k, spares, n) in a.iter(folded):
            at = end - n + 1
            if at and folded[at - 1].isalpha():
                continue
            if spares and (end + 1 == size or not folded[end + 1].isalpha()):
                spared.append((at, end))
            if k >= 0:
                found.append((at, k))
        if spared:
            spared.sort()
            starts, ends = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
            found = [(at, k) for at, k in found if (i := bisect_right(starts, at)) == 0 or ends[i - 1] < at]
        return Counter(k for _, k in found)

    def weight(self, a, folded: str) -> float:
        """The weighted, normalised hits."""
        words = n_words(folded)
        return sum(self.weights[k] * norm(c, words) for k, c in self.hits(a, folded).items())

    def score(self, a, text: str | None) -> float:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.weight(a, fold(text)), -500, 500)))


def norm(count: int, words: int) -> float:
    """A stem's hits against the length of the text: log of one plus its hits in 50 words, which a long text needs in proportion."""
    return float(np.log1p(count * 50.0 / max(words, 10)))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows with 0 are held out."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000) -> Lexicon:
    """Learn stems and weights from at most max_rows labelled rows (those first in the hash order of their ids) outside of the held-out fifth.

    A stem's weight is the lower end of its log odds of toxic against other texts, so rare stems weigh little. Stems, pairs
    of words and their counts are gathered over distinct texts by partial aggregation; those learned come to the driver, and
    of each training text one number, on which the scale and bias are fitted. Without labelled rows, or with labels all
    alike, the lexicon is empty and every score is the base rate's side of one half. Null labels and ids are left out; of
    labels that disagree on an id, toxic counts.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(remainder(F.col("doc_id")) != 0)
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows rows of 12 bytes: a proven bound.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxtrain")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        forget(sample)
        return Lexicon([], [], 4.0 if bad else -4.0)

    def counts(of):
        """In how many toxic (a) and other (c) texts each thing is that `of` finds in a folded text."""

        def run(batches):
            for batch in batches:
                seen: Counter = Counter()
                for t, v in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    seen.update((x, v) for x in of(fold(t)))
                if seen:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([c if k[1] else 0 for k, c in seen.items()], pa.int64()), pa.array([0 if k[1] else c for k, c in seen.items()], pa.int64())], names=["x", "a", "c"])

        return sample.mapInArrow(run, "x string, a long, c long").groupBy("x").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))

    odds = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1))
    error = ERRORS * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    stems = counts(lambda f: {w[:k] for w in set(_WORD.findall(f)) for k in STEM_LENGTHS if len(w) >= k})
    got = {r.x: (r.w, r.a, r.c) for r in stems.where((F.col("a") >= MIN_DOCS) & (odds - error > LEAST_ODDS)).select("x", "a", "c", (odds - error).alias("w")).collect()}
    # A stem that is in the same texts as one a letter longer gives way to it.
    same = {x[:-1] for x in got if got.get(x[:-1], ())[1:] == got[x][1:]}
    chosen = sorted(set(got) - same)

    def pairs(f: str) -> set[str]:
        return {f"{x} {z}" for x, z in re.findall(r"([^\W\d_]+)(?= ([^\W\d_]+))", f) if any(x[:k] in got for k in STEM_LENGTHS if k <= len(x))}

    spared = sorted(r.x for r in counts(pairs).where((F.col("c") >= MIN_DOCS) & (odds + error < 0)).select("x").collect())
    lex = Lexicon(chosen, [got[x][0] for x in chosen], 0.0, tuple(dict.fromkeys([*EXCEPTIONS, *spared])))

    def weighed(batches):
        a = lex.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("toxic"), pa.int32()), pa.array([float(lex.weight(a, fold(t))) for t in batch.column("text").to_pylist()], pa.float64())], names=["y", "x"])

    rows = sample.mapInArrow(weighed, "y int, x double").collect()  # at most max_rows
    forget(sample)
    w, b = _logistic(np.array([[r.x] for r in rows]), np.array([r.y for r in rows], dtype=float))
    return Lexicon(chosen, [float(v * w[0]) for v in lex.weights], float(b), lex.exceptions)


def _logistic(x: np.ndarray, t: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps with halving; rows in a fixed order, so the fit repeats."""
    order = np.lexsort((*x.T[::-1], t))
    x, t = np.hstack([x[order], np.ones((len(x), 1))]), t[order]
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - t @ (x @ w) + 0.5 * (pen * w * w).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - t) + pen * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        w = w - size * step
        if now - new < 1e-9 * (1 + abs(now)):
            break
        now = new
    return w[:-1], w[-1]


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(_row, score): the rows of docs with the score of each whole text. Null and empty texts have no hits and get the bias's score. An empty table gives an empty table."""

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()  # once a task
        for batch in texts:
            yield pd.Series([lexicon.score(a, t) for t in batch], dtype=float)

    return packed(docs, "text").select("_row", score("text").alias("score"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lex = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = scored(docs, lex).select("_row.doc_id", "score")
    return got.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
