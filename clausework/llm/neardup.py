"""MinHash near-dedup by ProbMinHash.

Each text is the weighted set of its runs of five words, a run's weight being its count. The elements' arrivals form
Poisson processes with the weights as rates; each arrival falls on a random register, and a register keeps the element
that came first. An element stops as soon as its next arrival is later than all registers. Registers of two texts agree
with the probability Jaccard similarity. Registers are banded, colliding texts are joined to candidate components, and
inside these exact weighted Jaccard similarity decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import U, clean_up, connected_components, forget, mix, owning, shingles, packed, small_side, text_key, written

#: 25 bands of 5 registers: a pair at 0.8 is missed with chance 5e-5, a pair at 0.3 is tried with chance 6 in 100.
BANDS, ROWS = 25, 5
TENTHS = 8


def weighted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements, their texts' numbers and counts, ordered by text and element."""
    h, of = shingles(texts)
    if not len(h):
        return h, of, np.zeros(0)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return h[first], of[first], np.diff(np.append(first, len(h))).astype(np.float64)


def prob_minhash(e: np.ndarray, of: np.ndarray, w: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n rows of m registers, each the element with the first arrival."""
    reg = np.full(n * m, np.inf)
    who = np.zeros(n * m, dtype=np.uint64)
    x = np.zeros(len(e))
    on, done = np.arange(len(e)), 0
    while len(on):
        k = 1 if done < 2 else 16  # arrivals drawn at once; those beyond the first late one change nothing
        raw = mix(e[on][:, None] + np.arange(done + 1, done + 1 + k, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        gaps = -np.log(((raw >> U(11)).astype(np.float64) + 1) * 2.0**-53) / w[on][:, None]
        t = x[on][:, None] + np.cumsum(gaps, axis=1)
        x[on] = t[:, -1]
        at = (of[on] * m)[:, None] + ((mix(raw ^ U(0xA24BAED4963EE407)) >> U(33)) % U(m)).astype(np.int64)
        t, at, el = t.ravel(), at.ravel(), np.repeat(e[on], k)
        ok = t < reg[at]
        t, at, el = t[ok], at[ok], el[ok]
        np.minimum.at(reg, at, t)
        won = t == reg[at]
        who[at[won]] = el[won]
        late = reg.reshape(n, m).max(axis=1)
        on = on[x[on] < late[of[on]]]
        done += k
    return who.reshape(n, m)


def band_keys(who: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    out = np.zeros((len(who), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x2545F4914F6CDD1D)
    for r in range(ROWS):
        out = mix(out ^ who[:, r : BANDS * ROWS : ROWS])
    return out.view(np.int64)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(_h1, _h2, class_id, rep, c): for the key of each distinct text, the smallest doc_id of its class and of its own copies, and a number of the class.

    Texts link at a weighted Jaccard similarity of 0.8 or more; classes are the components of links. Equal texts are one
    text before anything is joined. A text without words links with nothing.
    """
    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))

    def sign(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 768):
                b = batch.slice(k, 768)
                texts = b.column("text").to_pylist()
                e, of, w = weighted(texts)
                some, of = np.unique(of, return_inverse=True)
                keys = band_keys(prob_minhash(e, of, w, len(some)))
                sizes = np.zeros(len(texts), dtype=np.int32)
                sizes[some] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_h1"), b.column("_h2"), bands], names=["doc_id", "_h1", "_h2", "bands"])

    signed = keyed.mapInArrow(sign, "doc_id long, _h1 long, _h2 long, bands array<long>")
    texts = written(signed.groupBy("_h1", "_h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "mh-texts")
    keys = texts.select(F.col("_h1").alias("u"), F.explode("bands").alias("k"))
    met = written(keys.groupBy("k").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "m"), "mh-met")
    tried = connected_components(keys.join(met, "k").where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    members = written(tried.select(F.col("node").alias("_h1"), F.col("component").alias("g")).join(texts.select("_h1", "_h2", "rep"), "_h1"), "mh-members")
    forget(met)
    clean_up(tried)
    n = members.count()
    parts = _parts(docs)

    def elements(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                h, of = shingles(b.column("text").to_pylist())
                out = [_occurrences(h[x]) for x in _cuts(of, b.num_rows)]
                flat = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
                off = np.cumsum([0, *(len(x) for x in out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("g"), b.column("_h1"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64()))], names=["g", "u", "e"])

    wanted = keyed.join(small_side(members.withColumnRenamed("rep", "_rep"), n, 40), ["_h1", "_h2"]).where("doc_id <=> _rep")
    crowded = written(blocks.crowds(members.select("g")), "mh-crowded")
    dealt = blocks.tiled(wanted.select("g", "_h1", "text").mapInArrow(elements, "g long, u long, e array<long>"), crowded)
    links = written(blocks.forest(dealt, 2 * parts, TENTHS), "mh-links")
    linked = connected_components(links)
    comps = linked.select(F.col("node").alias("_h1"), F.col("component").alias("c"))
    told = written(texts.select("_h1", "_h2", "rep", "copies").join(comps, "_h1", "left").where("c IS NOT NULL OR copies > 1").withColumn("c", F.coalesce("c", "_h1")), "mh-told")
    forget(members, crowded, links, texts)
    clean_up(linked)
    least = told.groupBy("c").agg(F.min("rep").alias("class_id"))
    got = written(told.join(least, "c").select("_h1", "_h2", "class_id", "rep", "c"), "mh-classes")
    forget(told)
    return got


def _cuts(of: np.ndarray, n: int) -> list[slice]:
    at = np.searchsorted(of, np.arange(n + 1))
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def _occurrences(h: np.ndarray) -> np.ndarray:
    """The multiset h as a set: the k-th occurrence of an element is an element of its own, so that common elements count the smaller of two counts."""
    h = np.sort(h)
    first = np.searchsorted(h, h, side="left")
    return np.sort(mix(h + (np.arange(len(h)) - first).astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64))


def with_classes(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, _class, _c): the rows of docs with the smallest doc_id of its near-duplicate class, and a number of the class. Texts without words are classes of their own."""
    got = near_classes(docs)
    h1, h2 = text_key(F.col("text"))
    n = got.count()
    words = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x00-\\x20]")
    side = got.select("_h1", "_h2", F.col("class_id").alias("_class"), F.col("c").alias("_c"))
    out = packed(docs, "doc_id", "text").withColumn("_h1", h1).withColumn("_h2", h2).join(small_side(side, n, 40), ["_h1", "_h2"], "left").withColumn("_c", F.coalesce("_c", "_h1")).drop("_h1", "_h2")
    return owning(out.withColumn("_class", F.when(words & F.col("_class").isNotNull(), F.col("_class")).otherwise(F.col("doc_id"))), got)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) for each row. kept: the document with the smallest id of its class. Null ids: their class is that of their text, and they are kept only where all ids of the class are null."""
    got = with_classes(docs.select("doc_id", "text"))
    return owning(got.select("doc_id", F.col("_class").alias("class_id"), F.col("doc_id").eqNullSafe(F.col("_class")).alias("kept")), got)


def one_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: that with the smallest id. Of rows that repeat an id (or a null one) within a class, one stays; they are gathered only if there are any."""
    classed = with_classes(docs)
    got = classed.where(F.col("doc_id").eqNullSafe(F.col("_class")))
    total, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    return owning((got if total == distinct else got.dropDuplicates(["doc_id", "_c"])).select("_row.*"), classed)


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
