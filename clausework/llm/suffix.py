"""Suffix-array dedup: remove every byte that a repeated string of 200 bytes covers.

Every string of 200 bytes (a window) has one anchor: the 48 bytes in it with the smallest hash. Equal windows have equal
anchors, so windows are dealt to shards by anchor, in segments of consecutive windows; an anchor seen once cannot repeat and
is left out. Each shard gets a suffix array over its distinct segments (Larsson-Sadakane refinement in numpy) and the
common prefixes of neighbours (Kasai); a prefix of 200 bytes marks a repeated window. An anchor with very many distinct
segments is spread over several sub-arrays, and each pair of those is merged by binary search of one's windows in the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import U, forget, mix, packed, small_side, text_key, written

WINDOW = 200
GRAM = 48
_SLIDE = WINDOW - GRAM + 1
_TERMS = mix(np.arange(101, 101 + GRAM // 8, dtype=np.uint64)) | U(1)
PIECE = 1 << 16
LONGEST_RUN = 824
#: Distinct segments of one anchor in a sub-array at most; an anchor with more is tiled.
SEGMENTS = 256
SHARD_BYTES = 1 << 18


# ---------------------------------------------------------------- anchors


def words8(data: bytes) -> np.ndarray:
    """The eight bytes at each place as a little-endian number (zeros beyond the end)."""
    return np.ndarray((len(data),), dtype="<u8", buffer=data + b"\0" * 8, strides=(1,)).copy()


def anchor_runs(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: anchors, the first window of each anchor's run (runs follow each other up to the last window), and the anchors that lie at several places of their run."""
    pieces = []  # (text, its first byte, end)
    for k, t in enumerate(texts):
        for at in range(0, len(t) - WINDOW + 1, PIECE):
            pieces.append((k, at, min(len(t), at + PIECE + WINDOW - 1)))
    out: list[list] = [[] for _ in texts]
    group: list[tuple[int, int, int]] = []
    size = 0
    for p in [*pieces, None]:
        if group and (p is None or size + p[2] - p[1] > PIECE):
            _runs_of(texts, group, out)
            group, size = [], 0
        if p:
            group.append(p)
            size += p[2] - p[1]
    none = np.zeros(0, dtype=np.int64)
    return [tuple(np.concatenate(c) for c in zip(*x, strict=True)) if x else (none, none.astype(np.int32), none) for x in out]


def _runs_of(texts, group, out) -> None:
    data = b"".join(texts[k][a:b] for k, a, b in group)
    x = words8(data + b"\0" * GRAM)
    n = len(data)
    h = x[:n] * _TERMS[0]
    for j in range(1, GRAM // 8):
        h += x[8 * j : n + 8 * j] * _TERMS[j]
    h = mix(h)
    m = (h & U(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= _SLIDE:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if _SLIDE > width:
        m = np.minimum(m[: len(m) - (_SLIDE - width)], m[_SLIDE - width :])
    sizes = np.array([b - a for _, a, b in group])
    starts = np.cumsum(sizes) - sizes
    count = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(group)), count)
    within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    got = m[starts[of] + within]
    place = (got & U(0xFFFFF)).astype(np.int64)
    value = got >> U(20)
    new = np.ones(len(of), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(of)))
    if length.max() > LONGEST_RUN:
        more = [np.arange(f, f + ln, LONGEST_RUN) for f, ln in zip(first[length > LONGEST_RUN], length[length > LONGEST_RUN], strict=True)]
        long = np.repeat(length > LONGEST_RUN, length)
        first = np.union1d(first, np.concatenate(more))
    else:
        long = None
    several = np.maximum.reduceat(place, first) != np.minimum.reduceat(place, first)
    if long is not None:
        several |= long[first]
    fp = h[place[first]].view(np.int64)
    cuts = np.searchsorted(of[first], np.arange(len(group) + 1))
    for g, (k, a, _) in enumerate(group):
        s = slice(cuts[g], cuts[g + 1])
        out[k].append((fp[s], (within[first[s]] + a).astype(np.int32), fp[s][several[s]]))


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of segments laid end to end. ends: the end of its segment for each place; a segment's end sorts before all bytes and differs from other ends.

    Larsson-Sadakane: suffixes sorted by their first symbols are refined by the rank of the suffix h places on, h doubling;
    only groups that are not yet single are sorted again.
    """
    n = len(data)
    b = np.frombuffer(data, dtype=np.uint8)
    at = np.arange(n, dtype=np.int64)
    left = ends - at
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([b.astype(np.int64) + 1, np.zeros(8, dtype=np.int64)])
    for j in range(7):
        key *= 257
        key += np.where(left > j, padded[j : n + j], 0)
    sa = np.argsort(key)
    sorted_key = key[sa]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, dtype=np.int64)
    group = np.maximum.accumulate(np.where(head, at, 0))
    rank[sa] = group
    single = head & np.append(head[1:], True)
    todo = np.flatnonzero(~single)  # places in sa
    h = 7
    while len(todo):
        i = sa[todo]
        beyond = i + h
        second = np.where(beyond < ends[i], rank[np.minimum(beyond, n - 1)] + n, ends[i] - n)  # ends: 1 - n to 0, each segment's own
        g = group[todo]
        order = np.argsort(g * (2 * n + 1) + second + n)
        i, second = i[order], second[order]
        sa[todo] = i
        fresh = np.ones(len(todo), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
        group[todo] = np.maximum.accumulate(np.where(fresh, todo, 0))
        rank[i] = group[todo]
        todo = todo[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa, rank


def common_prefixes(data: bytes, ends: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Kasai: for each place the length that its suffix shares with the suffix before it in the array.

    The shared length falls by one at most from a place to the next, so comparison goes on from there. All segments are
    walked side by side; eight bytes are compared at a time.
    """
    n = len(data)
    x = words8(data)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, dtype=np.int64)
    last = np.unique(ends)
    first = np.concatenate(([0], last[:-1]))
    order = np.argsort(-(last - first), kind="stable")
    first, length = first[order], (last - first)[order]
    shared = np.zeros(len(first), dtype=np.int64)
    live = len(first)
    for t in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, side="left"))  # lanes longer than t
        i = first[:live] + t
        j = before[i]
        most = np.where(j >= 0, np.minimum(ends[i] - i, ends[j] - j), 0)
        got = np.maximum(shared[:live] - 1, 0)
        got = np.minimum(got, most)
        on = np.flatnonzero(got < most)
        while len(on):
            d = x[i[on] + got[on]] ^ x[j[on] + got[on]]
            same = d == 0
            low = d & (~d + U(1))
            step = np.where(same, 8, np.log2(np.maximum(low, U(1)).astype(np.float64)).astype(np.int64) >> 3)
            got[on] += step
            on = on[same]
            on = on[got[on] < most[on]]
        got = np.minimum(got, most)
        plcp[i] = got
        shared[:live] = got
    return plcp


def _layout(segments: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    last = np.cumsum(sizes)
    return b"".join(segments), np.repeat(last, sizes), last - sizes


def repeated_windows(segments: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For each place of the segments laid end to end: whether a string of `window` bytes starts there that starts at another place too."""
    data, ends, _ = _layout(segments)
    sa, rank = suffix_array(data, ends)
    enough = common_prefixes(data, ends, sa, rank)[sa] >= window
    marks = np.zeros(len(data), dtype=bool)
    marks[sa] = enough | np.append(enough[1:], False)
    return marks


def search_windows(index: list[bytes], queries: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For each place of the queries laid end to end: whether a window starts there that the index holds, by binary search in the index's suffix array."""
    data, ends, _ = _layout(index)
    sa, _ = suffix_array(data, ends)
    qdata, qends, _ = _layout(queries)
    q = np.flatnonzero(qends - np.arange(len(qdata)) >= window)
    marks = np.zeros(len(qdata), dtype=bool)
    if not len(q) or not len(sa):
        return marks
    x, y = words8(data).byteswap(), words8(qdata).byteswap()  # big-endian numbers compare as bytes do

    def compare(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the window at suffix s against that at place p; a suffix that ends first is smaller."""
        out = np.zeros(len(s), dtype=np.int8)
        on, at = np.arange(len(s)), 0
        left = ends[s] - s
        while len(on) and at < window:
            a, b = x[np.minimum(s[on] + at, len(x) - 1)], y[p[on] + at]
            k = np.minimum(np.minimum(left[on] - at, window - at), 8)
            cut = np.where(k < 8, (~U(0)) << (U(8) * (U(8) - np.maximum(k, 0).astype(np.uint64)) % U(64)), ~U(0))
            cut = np.where(k <= 0, U(0), cut)
            a, b2 = a & cut, b & cut
            out[on] = np.where(a < b2, -1, np.where(a > b2, 1, np.where((k < 8) & (at + k < window), -1, 0)))
            on = on[out[on] == 0]
            at += 8
        return out

    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), len(sa), dtype=np.int64)
    while True:
        on = np.flatnonzero(lo < hi)
        if not len(on):
            break
        mid = (lo[on] + hi[on]) // 2
        less = compare(sa[mid], q[on]) < 0
        lo[on] = np.where(less, mid + 1, lo[on])
        hi[on] = np.where(less, hi[on], mid)
    inside = np.flatnonzero(lo < len(sa))
    marks[q[inside]] = compare(sa[lo[inside]], q[inside]) == 0
    return marks


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.diff(mask.view(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


# ---------------------------------------------------------------- distributed


def _bytes(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_h1, _h2, _spans): for the key of each text with a repeated window, the maximal runs of bytes [lo, hi) that repeated windows cover.

    Equal texts are one text for the search; a text of 200 bytes or more with copies repeats wholly.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("_id"), F.coalesce("text", F.lit("")).alias("_t"), *text_key(F.col("text")))

    def anchors(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                got = anchor_runs([_bytes(t) for t in b.column("_t").to_pylist()])
                lists = [_lists([g[c] for g in got], kind) for c, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()))]
                sizes = pa.array([len(_bytes(t)) for t in b.column("_t").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h1"), b.column("_h2"), sizes, *lists], names=["_id", "_h1", "_h2", "_n", "_fp", "_at", "_more"])

    seen = keyed.mapInArrow(anchors, "_id long, _h1 long, _h2 long, _n long, _fp array<long>, _at array<int>, _more array<long>")
    texts = written(seen.groupBy("_h1", "_h2").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"), F.first("_n").alias("_n"), F.first("_fp").alias("_fp"), F.first("_at").alias("_at"), F.first("_more").alias("_more")), "sa-anchors")
    often = written(texts.select(F.explode(F.concat("_fp", "_more")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("fp"), "sa-often")
    last = F.col("_n") - WINDOW
    runs = texts.select("_id", "_h1", "_h2", F.explode(F.arrays_zip(F.col("_fp").alias("fp"), F.col("_at").alias("a"), F.transform("_at", lambda x, k: F.coalesce(F.try_element_at("_at", k + 2) - 1, last.cast("int"))).alias("b"))).alias("r"))
    hits = written(runs.select("_id", "_h1", "_h2", F.col("r.fp").alias("fp"), F.col("r.a").alias("a"), F.col("r.b").alias("b")).join(often, "fp").groupBy("_id", "_h1", "_h2").agg(F.collect_list(F.struct("fp", "a", "b")).alias("_runs")), "sa-hits")
    n_hits = hits.count()

    def segments(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                cols: list[list] = [[] for _ in range(7)]
                for h1, h2, t, runs in zip(*(b.column(c).to_pylist() for c in ("_h1", "_h2", "_t", "_runs")), strict=True):
                    t = _bytes(t)
                    for r in runs:
                        s = t[r["a"] : r["b"] + WINDOW]
                        d = xxhash.xxh3_128_digest(s)
                        for c, v in zip(cols, (h1, h2, r["a"], r["fp"], int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), s), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["_h1", "_h2", "a", "fp", "d1", "d2", "s"])

    ids = hits.select("_id", "_h1", "_h2")
    wanted = keyed.join(small_side(ids, n_hits, 24), ["_id", "_h1", "_h2"], "left_semi")
    cut = wanted.join(hits, ["_id", "_h1", "_h2"]).select("_h1", "_h2", "_t", "_runs").mapInArrow(segments, "_h1 long, _h2 long, a int, fp long, d1 long, d2 long, s binary")
    placed = written(cut, "sa-segments")
    forget(hits, often)
    distinct = written(placed.groupBy("fp", "d1", "d2").agg(F.count(F.lit(1)).alias("k"), F.first("s").alias("s")), "sa-distinct")
    crowded = written(distinct.groupBy("fp").count().where(F.col("count") > SEGMENTS).select("fp", F.ceil(F.col("count") / SEGMENTS).cast("int").alias("m")), "sa-crowded")
    dealt = distinct.join(crowded, "fp", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod("d1", F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
    dealt = dealt.select("fp", "i", "j", "c", "d1", "d2", "k", "s").repartition(2 * parts, "fp", "i", "j").sortWithinPartitions("fp", "i", "j")
    found = written(dealt.mapInArrow(_judge, "fp long, d1 long, d2 long, r array<struct<lo:int,hi:int>>"), "sa-found")
    forget(crowded, distinct)
    marked = placed.select("_h1", "_h2", "a", "fp", "d1", "d2").join(found, ["fp", "d1", "d2"]).select("_h1", "_h2", F.transform("r", lambda x: F.struct((x["lo"] + F.col("a")).alias("lo"), (x["hi"] + F.col("a")).alias("hi"))).alias("r"))
    whole = texts.where((F.col("_copies") > 1) & (F.col("_n") >= WINDOW)).select("_h1", "_h2", F.array(F.struct(F.lit(0).alias("lo"), last.cast("int").alias("hi"))).alias("r"))
    gathered = marked.unionByName(whole).groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("r")).alias("_spans"))
    spans = written(gathered.mapInArrow(_joined, "_h1 long, _h2 long, _spans array<struct<lo:int,hi:int>>"), "sa-spans")
    forget(placed, found, texts)
    return spans


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _judge(batches):
    """Rows sorted by (fp, i, j): blocks of whole anchors with i = j get one suffix array; tiles of two chunks are merged by search."""
    held: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["fp"], row["i"], row["j"]) != (held[-1]["fp"], held[-1]["i"], held[-1]["j"]) and (size > SHARD_BYTES or row["i"] != row["j"] or held[-1]["i"] != held[-1]["j"]):
                yield from _block(held)
                held, size = [], 0
            held.append(row)
            size += len(row["s"])
    if held:
        yield from _block(held)


def _block(rows: list[dict]):
    out: list[tuple] = []
    if rows[0]["i"] == rows[0]["j"]:
        parts = [(rows, repeated_windows([r["s"] for r in rows]))]
    else:
        one, two = ([r for r in rows if r["c"] == x] for x in (rows[0]["i"], rows[0]["j"]))
        if not one or not two:
            return
        a, b = [r["s"] for r in one], [r["s"] for r in two]
        parts = [(two, search_windows(a, b)), (one, search_windows(b, a))]
    for some, marks in parts:
        at = 0
        for r in some:
            n = len(r["s"])
            runs = [(0, n - WINDOW)] if r["k"] > 1 else _runs(marks[at : at + n - WINDOW + 1])
            at += n
            if runs:
                out.append((r["fp"], r["d1"], r["d2"], [{"lo": a, "hi": b} for a, b in runs]))
    if out:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["fp", "d1", "d2", "r"])


def _joined(batches):
    """Runs of window starts of a text to the maximal runs of bytes [lo, hi) that they cover."""
    for batch in batches:
        rows = []
        for spans in batch.column("_spans").to_pylist():
            out: list[dict] = []
            for a, b in sorted((s["lo"], s["hi"] + WINDOW) for s in spans):
                if out and a <= out[-1]["hi"]:
                    out[-1]["hi"] = max(out[-1]["hi"], b)
                else:
                    out.append({"lo": a, "hi": b})
            rows.append(out)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("_h1"), batch.column("_h2"), pa.array(rows, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["_h1", "_h2", "_spans"])


def merged(spans) -> list[tuple[int, int]]:
    return [] if spans is None else [(s["lo"], s["hi"]) for s in spans]


def with_spans(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text, _spans): the rows of docs with the repeated runs of their texts (null: none)."""
    spans = repeated_spans(docs)
    rows, total = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    h1, h2 = text_key(F.col("text"))
    return packed(docs, "doc_id", "text").withColumn("_h1", h1).withColumn("_h2", h2).join(small_side(spans, 1, 60 * rows + 24 * total), ["_h1", "_h2"], "left").drop("_h1", "_h2")


def removed_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs. Null texts are empty; repeated rows repeat each other's text and so lose what a copy loses; empty input gives no rows."""

    def digest(batches):
        for batch in batches:
            rows = []
            for i, t, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_spans")), strict=True):
                t, cut, at = _bytes(t), merged(spans), 0
                h = hashlib.sha256()
                for a, b in cut:
                    h.update(t[at:a])
                    at = b
                h.update(t[at:])
                rows.append((i, len(t), sum(b - a for a, b in cut), len(cut), h.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text")).select("doc_id", "text", "_spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text; a cut that would split a character leaves that character. n_chars, if there, follows. Documents stay, whatever is left of them."""
    @pandas_udf("string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if s is None or not len(s):
                out.append(t)
                continue
            raw, at, left = _bytes(t), 0, []
            for a, b in merged(s):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                left.append(raw[at:a])
                at = b
            out.append(b"".join([*left, raw[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    row = F.col("_row").withField("text", keep("text", "_spans"))
    got = with_spans(docs).select(row.alias("_row"))
    if "n_chars" in docs.columns:
        got = got.select(F.col("_row").withField("n_chars", F.length("_row.text").cast(docs.schema["n_chars"].dataType)).alias("_row"))
    return got.select("_row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return removed_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
