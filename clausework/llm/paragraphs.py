"""Substring dedup: paragraphs repeated across documents.

A text's paragraphs are its lines of `line_words` words or more, the whole of it if it has under 20 words, and stretches of
20 words that begin at the smallest of the hashes of five words in a window, so equal passages of 35 words or more, wherever
they stand in a line, have a stretch in common (31 and more nearly always). A paragraph is a set of runs of five words (one
of under five words is one run, so only equal ones are near). Equal paragraphs meet by their hash. Lines and short texts
also meet in bands of MinHashes over all their runs, tuned to miss a pair at 0.8 with chance 0.7 %; the exact Jaccard
similarity decides, and components of links are clusters. In each cluster the first paragraph stays, the others go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import SHINGLE_WORDS, U, _STEP, clean_up, connected_components, counted, forget, mix, owning, small_side, text_key, word_hashes, written

WORDS = 20
#: Runs of five words among which an anchor is the smallest: 16 words.
SLIDE = 12
#: At 0.8 a band of three is equal with chance 0.512, and all of seven differ with 0.0066.
BANDS, ROWS = 7, 3
TENTHS = 8
#: Lines of fewer words recur in documents that share nothing else (40 in 100 of those in a test corpus have such a line).
LINE_WORDS = 20
_NONE = np.zeros(0, dtype=np.int64)


def _anchors(runs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words at which a stretch begins that lies wholly in its text."""
    span = SLIDE + SHINGLE_WORDS - 1
    n = len(of) - span + 1
    if n <= 0:
        return _NONE
    m, width = runs, 1
    while 2 * width <= SLIDE:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if SLIDE > width:
        m = np.minimum(m[: len(m) - (SLIDE - width)], m[SLIDE - width :])
    m = m[:n]
    whole = of[:n] == of[span - 1 :]
    new = whole.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~whole[:-1]
    w = np.flatnonzero(new)  # a window whose smallest is not that of the one before
    at, left = w.copy(), np.ones(len(w), dtype=bool)
    for k in range(SLIDE):  # the first place in the window with that hash
        hit = left & (runs[w + k] == m[w])
        at[hit] += k
        left &= ~hit
        if not left.any():
            break
    at = np.unique(at[at + WORDS <= len(of)])
    return at[of[at] == of[at + WORDS - 1]]


class Units:
    """Paragraphs of texts laid end to end, in order of text: text number, first word in it, number of words, whether it is a line or whole text, hash u of the runs, and the place of the runs among all."""

    def __init__(self, texts: list[str | None], line_words: int = LINE_WORDS):
        h, of, start, _, data = word_hashes(texts)
        words = len(h)
        self.words = np.bincount(of, minlength=len(texts)) if words else np.zeros(len(texts), dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(self.words)))[:-1]
        # Runs of five words from each word on.
        runs = np.zeros(words, dtype=np.uint64)
        full = max(0, words - SHINGLE_WORDS + 1)
        for k in range(SHINGLE_WORDS):
            runs[:full] += h[k : k + full] * _STEP[k]
        runs = mix(runs)
        line = np.cumsum(np.frombuffer(data, dtype=np.uint8) == 10)[start]
        new = np.flatnonzero(np.diff(line, prepend=-1)) if words else _NONE
        size = np.diff(np.append(new, words))
        lines = np.bincount(of[new], minlength=len(texts))
        short = self.words < WORDS
        keep = (size >= line_words) | (short[of[new]] & (lines[of[new]] == 1))
        several = np.flatnonzero(short & (lines > 1))  # whole short texts that are more than a line
        anchors = _anchors(runs[:full], of)
        at = np.concatenate((new[keep], first[several], anchors)).astype(np.int64)
        n = np.concatenate((size[keep], self.words[several], np.full(len(anchors), WORDS))).astype(np.int64)
        own = int(keep.sum()) + len(several)
        code, back = np.unique(at * (words + 1) + n, return_inverse=True)
        self.line = np.zeros(len(code), dtype=bool)
        self.line[back[:own]] = True
        at, n = code // (words + 1), code % (words + 1)
        few = np.flatnonzero(n < SHINGLE_WORDS)  # one run for each of fewer words
        tail = np.zeros(len(few), dtype=np.uint64)
        for k in range(SHINGLE_WORDS - 1):
            tail += np.where(k < n[few], h[np.minimum(at[few] + k, max(0, words - 1))], U(0)) * _STEP[k] if words else U(0)
        self.runs = np.concatenate((runs, mix(tail)))
        self.lo, self.hi = at.copy(), at + n - SHINGLE_WORDS + 1
        self.lo[few] = words + np.arange(len(few))
        self.hi[few] = self.lo[few] + 1
        self.few = n < SHINGLE_WORDS
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(self.runs ^ U(0x9E3779B97F4A7C15)))))
        self.u = mix(sums[self.hi] - sums[self.lo] + (self.hi - self.lo).astype(np.uint64)).view(np.int64)
        self.text = of[at] if words else at
        self.at, self.n = (at - first[self.text]).astype(np.int32), n.astype(np.int32)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines and whole texts of five words or more, and their keys (BANDS for each)."""
        some = np.flatnonzero(~self.few & self.line)
        keys = np.zeros((len(some), BANDS), dtype=np.uint64)
        if len(some):
            ends = np.stack((self.lo[some], self.hi[some]), axis=1).ravel()
            for k in range(BANDS):
                key = np.full(len(some), k + 1, dtype=np.uint64)
                for r in range(ROWS):
                    v = mix(self.runs ^ mix(np.array([1 + k * ROWS + r], dtype=np.uint64)))
                    key = mix(key * U(3) + np.minimum.reduceat(np.append(v, U(0)), ends)[::2])
                keys[:, k] = key
        return some, keys.view(np.int64)

    def runs_of(self, k: int) -> np.ndarray:
        return self.runs[self.lo[k] : self.hi[k]]


def _lists(of: np.ndarray, n: int, *values: np.ndarray, each: int = 1) -> list[pa.ListArray]:
    """values, whose texts' numbers are `of` (in order), as a list for each of n texts."""
    off = pa.array((np.searchsorted(of, np.arange(n + 1)) * each).astype(np.int32))
    return [pa.ListArray.from_arrays(off, pa.array(v)) for v in values]


def repeated_paragraphs(docs: DataFrame, *, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, first_word, n_words, keeper_id, removed) for each repeated passage of each document.

    keeper_id: the smallest id of a document with a paragraph of the cluster; there the first one stays. Consecutive
    paragraphs of a document with one keeper that overlap or touch are one passage. Equal texts: all copies repeat wholly
    (a text without words has no row), and the passages inside are told for the first copy only. A paragraph repeated only
    inside one text is left alone. Null texts are empty; rows with a null id take part in the search, are never keepers
    unless all in a cluster are, and are not returned. A repeated row is a copy. Paragraphs are told apart by 64-bit hashes,
    texts by 128 bits. Empty input: no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), *text_key(F.col("text")))

    def listed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                x = Units(b.column("_t").to_pylist(), line_words)
                some, keys = x.bands()
                lists = [*_lists(x.text, b.num_rows, (x.at.astype(np.int64) << 32) | x.n, x.u), *_lists(x.text[some], b.num_rows, x.u[some]), *_lists(x.text[some], b.num_rows, keys.ravel(), each=BANDS)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_h1"), b.column("_h2"), pa.array(x.words.astype(np.int32)), *lists], names=["doc_id", "_h1", "_h2", "words", "spot", "u", "lu", "keys"])

    seen = keyed.mapInArrow(listed, "doc_id long, _h1 long, _h2 long, words int, spot array<long>, u array<long>, lu array<long>, keys array<long>")
    firsts = [F.first(c).alias(c) for c in ("words", "spot", "u", "lu", "keys")]
    texts = written(seen.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *firsts), "pg-texts")
    # Equal paragraphs of different texts.
    shared = texts.select("_h1", F.explode("u").alias("u")).groupBy("u").agg(F.min("_h1").alias("a"), F.max("_h1").alias("b")).where("a != b").select("u")
    # Different paragraphs under one key; equal groups of them have one name.
    lines = texts.select("lu", F.posexplode("keys").alias("k", "key")).select("key", F.get("lu", F.floor(F.col("k") / BANDS).cast("int")).alias("u"))
    several = lines.groupBy("key").agg(F.min("u").alias("a"), F.max("u").alias("b")).where("a != b").select("key")
    met = written(lines.join(several, "key").distinct(), "pg-met")
    names = met.groupBy("key").agg(F.bit_xor(F.xxhash64("u")).alias("x"), F.count(F.lit(1)).alias("n")).select("key", F.xxhash64("x", "n").alias("g"))
    groups = written(met.join(names, "key").select("g", "u").distinct(), "pg-groups")
    forget(met)
    both = shared.select("u", F.lit(False).alias("tried")).unionByName(groups.select("u", F.lit(True).alias("tried")))
    wanted = both.groupBy("u").agg(F.bool_or("tried").alias("tried"))
    # Four longs a paragraph are shuffled; a text is named by its hash and smallest id.
    placed = texts.select("rep", "_h1", F.explode(F.arrays_zip("spot", "u")).alias("r")).select("rep", "_h1", "r.spot", "r.u")
    spots = written(placed.join(wanted, "u").select("u", "tried", "rep", "_h1", F.shiftright("spot", 32).cast("int").alias("at"), F.col("spot").bitwiseAND((1 << 32) - 1).cast("int").alias("n")), "pg-spots")
    copied = written(texts.where("copies > 1 AND words > 0").select("_h1", "_h2", "rep", "words"), "pg-copied")
    forget(texts)
    # Each paragraph to verify is cut once more from one text that has it.
    where = spots.where("tried").groupBy("u").agg(F.min(F.struct("_h1", "rep")).alias("r"))
    hits = counted(where.groupBy("r._h1", F.col("r.rep").alias("doc_id")).agg(F.collect_list("u").alias("us")), "pg-hits", F.size("us"))
    some = small_side(hits[0], 24 * hits[1] + 8 * hits[2], 1).withColumnRenamed("doc_id", "_rep")
    cut_from = keyed.join(some, "_h1").where("doc_id <=> _rep").select("_t", "us")

    def cut(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                b = batch.slice(k, 128)
                x = Units(b.column("_t").to_pylist(), line_words)
                ends = np.searchsorted(x.text, np.arange(b.num_rows + 1))
                us, es = [], []
                for j, want in enumerate(b.column("us").to_pylist()):
                    mine, at = np.unique(x.u[ends[j] : ends[j + 1]], return_index=True)
                    for i in at[np.isin(mine, np.array(want, dtype=np.int64))].tolist():
                        us.append(x.u[ends[j] + i])
                        es.append(np.unique(x.runs_of(ends[j] + i)).view(np.int64))
                if us:
                    off = pa.array(np.cumsum([0, *map(len, es)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(us)), pa.ListArray.from_arrays(off, pa.array(np.concatenate(es)))], names=["u", "e"])

    # Rows with one id and text are the same, and any of them will do.
    sets = cut_from.mapInArrow(cut, "u long, e array<long>").dropDuplicates(["u"])
    members = written(groups.join(sets, "u").select("g", "u", "e"), "pg-members")
    crowded = written(blocks.crowds(members), "pg-crowded")
    links = written(blocks.forest(blocks.tiled(members, crowded), 2 * parts, TENTHS), "pg-links")
    forget(groups, hits[0], members, crowded)
    linked = connected_components(links)
    comps = counted(linked.select(F.col("node").alias("u"), F.col("component").alias("c")), "pg-comps")
    clean_up(linked)
    forget(links)
    told = written(spots.drop("tried").join(small_side(*comps, 32), "u", "left").withColumn("c", F.coalesce("c", "u")).drop("u"), "pg-told")
    forget(spots, comps[0])
    kept = told.groupBy("c").agg(F.min("rep").alias("keeper"), F.min("_h1").alias("a"), F.max("_h1").alias("b")).where("a != b").select("c", "keeper")
    by_text = told.where("rep IS NOT NULL").join(kept, "c").groupBy("_h1", "rep").agg(F.collect_list(F.struct("at", "n", "c", "keeper")).alias("spots"))

    def passages(batches):
        for batch in batches:
            rows = []
            for i, spots in zip(*(batch.column(c).to_pylist() for c in ("rep", "spots")), strict=True):
                stays: dict[int, int] = {}  # where the kept paragraph of a cluster ends, in the keeper's own text
                out = []
                for s in sorted(spots, key=lambda s: (s["at"], s["n"])):
                    end = s["at"] + s["n"]
                    gone = s["keeper"] != i or s["at"] >= stays.setdefault(s["c"], end)
                    out.append((s["keeper"], gone, s["at"], end))
                now = None
                for keeper, gone, at, end in sorted(out):
                    if now and now[1:3] == [keeper, gone] and at <= now[4]:
                        now[4] = max(now[4], end)
                    else:
                        now = [i, keeper, gone, at, end]
                        rows.append(now)
            if rows:
                i, keeper, gone, at, end = zip(*rows, strict=True)
                at, end = np.array(at, dtype=np.int32), np.array(end, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(at), pa.array(end - at), pa.array(keeper, pa.int64()), pa.array(gone, pa.bool_())], names=["doc_id", "first_word", "n_words", "keeper_id", "removed"])

    found = written(by_text.mapInArrow(passages, "doc_id long, first_word int, n_words int, keeper_id long, removed boolean"), "pg-found")
    forget(told)
    n = copied.count()
    whole = keyed.drop("_t").where("doc_id IS NOT NULL").join(small_side(copied, n, 40), ["_h1", "_h2"])
    whole = whole.select("doc_id", F.lit(0).alias("first_word"), F.col("words").alias("n_words"), F.col("rep").alias("keeper_id"), (F.col("doc_id") != F.col("rep")).alias("removed"))
    return owning(found.unionByName(whole), found, copied)


def op6(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
