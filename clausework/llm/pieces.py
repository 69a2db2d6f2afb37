"""SentencePiece-style encoding with seeded merge-dropout, and its decoding.

A text is cut into words (white space marked before them), and each word's characters are merged by an agenda of
candidate pairs in order of score. Each candidate taken from the agenda is skipped with the dropout rate, by a hash keyed
by the seed, the variant, the word's number in the text and the candidate's number in the word: every occurrence of a word
is cut anew, and a variant's text always alike. Characters outside of the vocabulary become byte pieces. Decoding joins
pieces, so every segmentation gives the text back.

Words of many occurrences are merged side by side in numpy, one step of all their agendas at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MASK, U, mix, mix_int, packed

#: An input: every worker must have this file. Callers may name another.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: When the cache is full, the cuttings of words up to this length stay; longer words seldom recur.
SHORT = 8
#: Words whose undropped cuttings are kept in a worker's cache, at some 250 bytes each.
CACHE = 600_000
#: Variants that there are: with these, a document and copy has its own.
VARIANTS = (1 << 31) - 1
#: Words up to this length are merged side by side, so many rows of them at once.
WIDE, ROWS = 40, 16_384
#: Characters of texts encoded together, or one text that is longer.
TOGETHER = 1 << 20
NO_RANK = np.int32(2**31 - 1)
_WORD_STEP, _CANDIDATE_STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def text_key(seed: int, variant: int) -> int:
    return mix_int(mix_int(seed * 0x9E3779B97F4A7C15 + variant) + 0x632BE59BD9B4E019)


class Merges:
    """The vocabulary's merges as a hash table over pairs of piece numbers (0: none), with open addressing."""

    def __init__(self, ranks: dict[str, int], ids: dict[str, int]):
        names = sorted({*ids, *(c for p in ids for c in p)})
        self.number = {p: k for k, p in enumerate(names, 1)}
        self.id = np.array([-1, *(ids.get(p, -1) for p in names)], dtype="<i4")
        self.of_char = np.zeros(0x110000, dtype=np.int32)
        for p, k in self.number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        pairs = {}
        for p, r in ranks.items():
            for cut in range(1, len(p)):
                x, y = self.number.get(p[:cut]), self.number.get(p[cut:])
                if x and y:
                    pairs[x << 24 | y] = (r, self.number[p])
        self.shift = 64 - max(4, (8 * len(pairs)).bit_length())
        size = 1 << (64 - self.shift)
        self.keys, self.ranks, self.merged = np.full(size, -1, dtype=np.int64), np.full(size, NO_RANK), np.zeros(size, dtype=np.int32)
        for key, (r, m) in pairs.items():
            h = (key * 0xD6E8FEB86659FD93 & MASK) >> self.shift
            while self.keys[h] >= 0:
                h = (h + 1) % size
            self.keys[h], self.ranks[h], self.merged[h] = key, r, m

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and numbers of merged pieces; NO_RANK where there is no such merge."""
        key = x.astype(np.int64) << 24 | y
        h = ((key.view(np.uint64) * U(0xD6E8FEB86659FD93)) >> U(self.shift)).astype(np.int64)
        at = self.keys[h]
        bad = np.flatnonzero((at != key) & (at >= 0))
        while len(bad):
            h[bad] = (h[bad] + 1) & (len(self.keys) - 1)
            at = self.keys[h[bad]]
            bad = bad[(at != key[bad]) & (at >= 0)]
        return self.ranks[h], self.merged[h]


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL):
    """Scores by piece, ids by piece, bytes of each id, and the first id of the byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    ids, surface = {}, [b""] * n
    byte_id = [0] * 256
    for k in range(n):
        p = m.id_to_piece(k)
        if m.is_byte(k):
            byte_id[int(p[3:5], 16)] = k
            surface[k] = bytes((int(p[3:5], 16),))
        elif not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)):
            ids[p] = k
            surface[k] = p.replace(SPACE, " ").encode()
    scores = {p: m.get_score(k) for p, k in ids.items()}
    return scores, ids, surface, byte_id


class Encoder:
    """Encodes under one seed and dropout rate. The cache holds words' ids without drops and how many candidates they take, so it changes no result."""

    def __init__(self, path: str = MODEL, *, seed: int = 11, dropout: float = 0.1):
        self.scores, self.ids, self.surface, self.byte_id = vocabulary(path)
        self.ranks = {p: int(-s) for p, s in self.scores.items() if len(p) > 1}
        self.merges = merges(path)
        self.packed = {p: struct.pack("<i", k) for p, k in self.ids.items()}
        self.seed, self.dropout = seed, dropout
        self.below = min(int(dropout * 2.0**64), MASK)
        # Signs that the cutting uses itself are marked by the second of them.
        self.fixed = {"\u0001" + c: self._bytes(c) for c in (SPACE, "\u0001")}
        self.cache: dict[str, bytes] = dict(self.fixed)
        self.candidates: dict[str, int] = dict.fromkeys(self.fixed, 0)
        # Words are cut around characters that no longer piece has, which changes nothing.
        stops = "".join(c for c in "\n\u0001" if not any(c in p for p in self.ids if len(p) > 1))
        self.words = re.compile(rf"{SPACE}*[^{SPACE}{stops}]+|{SPACE}*[{stops}]+|{SPACE}+" if stops else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def dropped(self, key: int, candidate: int) -> bool:
        """Whether the word with this key loses its candidate of this number."""
        return mix_int(key + candidate * int(_CANDIDATE_STEP)) < self.below

    def word(self, word: str, key: int | None = None) -> tuple[bytes, int]:
        """Ids of one word of any length as little-endian 32-bit numbers, and how many candidates the agenda gave; with a key, some are dropped."""
        ranks, packed, n = self.ranks, self.packed, len(word)
        agenda = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
        size, left, taken = [1] * n, list(range(-1, n - 1)), 0
        heapq.heapify(agenda)
        while agenda:
            _, a, total = heapq.heappop(agenda)
            one = size[a]
            b = a + one
            if not one or b >= n or one + size[b] != total:
                continue  # it or its neighbour was merged meanwhile
            taken += 1
            if key is not None and self.dropped(key, taken - 1):
                continue
            size[a], size[b] = total, 0
            c = a + total
            if c < n:
                left[c] = a
                e = c + size[c]
                if (r := ranks.get(word[a:e])) is not None:
                    heapq.heappush(agenda, (r, a, e - a))
            z = left[a]
            if z >= 0 and (r := ranks.get(word[z:c])) is not None:
                heapq.heappush(agenda, (r, z, c - z))
        return b"".join([packed.get(p) or self._bytes(p) for k, m in enumerate(size) if m for p in (word[k : k + m],)]), taken

    def _bytes(self, piece: str) -> bytes:
        """Byte pieces of what the vocabulary lacks."""
        return b"".join([struct.pack("<i", self.byte_id[x]) for x in piece.encode("utf-8", "surrogatepass")])

    def cut(self, words: list[str], keys: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray]:
        """word() of many words."""
        out: list[bytes] = [b""] * len(words)
        taken = np.zeros(len(words), dtype=np.int64)
        n = np.fromiter(map(len, words), np.int64, len(words))
        chars = self.merges.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        start = np.cumsum(n) - n
        plain = (n > 1) & (n <= WIDE)
        plain[plain] &= np.minimum.reduceat(chars, start)[plain] > 0 if len(chars) else False
        for k in np.flatnonzero(~plain).tolist():
            out[k], taken[k] = self.word(words[k], None if keys is None else int(keys[k]))
        order = np.flatnonzero(plain)
        order = order[np.argsort(n[order], kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(n[order], prepend=-1)), len(order))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for at in range(lo, hi, ROWS):
                some = order[at : min(at + ROWS, hi)]
                ids, ends, taken[some] = self._side_by_side(chars[start[some][:, None] + np.arange(n[some[0]])], None if keys is None else keys[some])
                data, ends = ids.tobytes(), (4 * ends).tolist()
                for k, a, b in zip(some.tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[k] = data[a:b]
        return out, taken

    def _side_by_side(self, chars: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of one length (numbers of their characters, a row each) laid end to end, where each ends, and candidates taken."""
        rows, length = chars.shape
        width = length + 1  # the last place stands for none
        piece = np.zeros((rows, width), dtype=np.int32)
        piece[:, :length] = chars
        rank = np.full((rows, width), NO_RANK)
        merged = np.zeros((rows, width), dtype=np.int32)
        pairs = self.merges.find(chars[:, :-1].ravel(), chars[:, 1:].ravel())
        rank[:, : length - 1], merged[:, : length - 1] = (x.reshape(rows, length - 1) for x in pairs)
        after = np.tile(np.arange(1, width + 1, dtype=np.int64), rows)
        before = np.tile(np.append(length, np.arange(width - 1)), rows)
        piece, rank, merged = piece.ravel(), rank.ravel(), merged.ravel()
        taken = np.zeros(rows, dtype=np.int64)
        live, base, step = np.arange(rows), np.arange(rows) * width, 0
        table = rank.reshape(rows, width)
        while len(live):
            at = (table if len(live) == rows else table[live]).argmin(axis=1)
            spot = base + at
            ok = rank[spot] < NO_RANK
            taken[live[~ok]] = step
            live, base, spot = live[ok], base[ok], spot[ok]
            go, f = spot, base
            if keys is not None:
                drop = mix(keys[live] + U(step * int(_CANDIDATE_STEP) & MASK)) < U(self.below)
                rank[spot[drop]] = NO_RANK
                go, f = spot[~drop], base[~drop]
            a = go - f
            b = f + after[go]
            e, z = f + after[b], f + before[go]
            new = merged[go]
            piece[go], piece[b], rank[b] = new, 0, NO_RANK
            after[go], before[e] = e - f, a
            rank[go], merged[go] = self.merges.find(new, piece[e])
            rank[z], merged[z] = self.merges.find(piece[z], new)
            step += 1
        there = piece > 0
        return self.merges.id[piece[there]], np.cumsum(there.reshape(rows, width).sum(axis=1)), taken

    def split(self, text: str | None) -> list[str]:
        """Words of the whole text (null: empty). A space is put before a text that is not empty."""
        if not text:
            return []
        if SPACE not in text and "\u0001" not in text:
            return self.words.findall(SPACE + text.replace(" ", SPACE))
        out = []
        for k, x in enumerate(re.split(f"([{SPACE}\u0001])", text)):
            out += ["\u0001" + x] if k % 2 else self.words.findall(("" if k else SPACE) + x.replace(" ", SPACE))
        return out

    def encode_many(self, texts: list[str | None], variants: list[int]) -> list[tuple[bytes, int]]:
        """Ids of each text as little-endian 32-bit numbers, and how many there would be without drops."""
        lists = [self.split(t) for t in texts]
        flat = list(chain.from_iterable(lists))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        cache, candidates = self.cache, self.candidates
        if len(cache) > CACHE:
            for full in (cache, candidates):
                for key in [key for key in full if len(key) > SHORT]:
                    del full[key]
            if len(cache) > CACHE // 2:
                cache, candidates = self.cache, self.candidates = dict(self.fixed), dict.fromkeys(self.fixed, 0)
        words = list(dict.fromkeys(flat))
        new = [w for w in words if w not in cache]
        if new:
            got, taken = self.cut(new)
            cache.update(zip(new, got, strict=True))
            candidates.update(zip(new, taken.tolist(), strict=True))
        which = np.fromiter(map(dict(zip(words, range(len(words)), strict=True)).get, flat), np.int64, len(flat))
        known = np.empty(len(words), dtype=object)
        known[:] = list(map(cache.get, words))
        out = known[which]
        ends = np.cumsum(sizes)
        whole = np.concatenate(([0], np.cumsum(np.fromiter(map(len, known), np.int64, len(words))[which])))
        full = (whole[ends] - whole[ends - sizes]) // 4
        if self.dropout and flat:
            text = np.array([text_key(self.seed, v) for v in variants], dtype=np.uint64)
            keys = np.repeat(text, sizes) + (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)).astype(np.uint64) * _WORD_STEP
            n = np.fromiter(map(candidates.get, words), np.int64, len(words))[which]
            of = np.repeat(np.arange(len(flat)), n)
            turn = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            some = np.unique(of[mix(keys[of] + turn.astype(np.uint64) * _CANDIDATE_STEP) < U(self.below)])
            got, _ = self.cut([flat[k] for k in some.tolist()], keys[some])
            for k, x in zip(some.tolist(), got, strict=True):
                out[k] = x
        out = out.tolist()
        return [(b"".join(out[b - k : b]), f) for b, k, f in zip(ends.tolist(), sizes.tolist(), full.tolist(), strict=True)]

    def encode(self, text: str | None, variant: int = 0) -> bytes:
        return self.encode_many([text], [variant])[0][0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for."""
        surface = self.surface
        out = b"".join([surface[k] for k in np.frombuffer(ids, dtype="<i4").tolist()])
        return out[1:] if out[:1] == b" " else out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    scores, ids, _, _ = vocabulary(path)
    return Merges({p: int(-s) for p, s in scores.items() if len(p) > 1}, ids)


@lru_cache(maxsize=1)
def encoder(path: str, seed: int, dropout: float) -> Encoder:
    """One encoder a worker process: its cache serves all tasks that the process runs."""
    return Encoder(path, seed=seed, dropout=dropout)


def variant_of(seed: int, variants: int, *keys) -> Column:
    """A document's (and copy's) variant, hashed from the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(variants)).cast("int")


def _together(batch: pa.RecordBatch):
    """Slices of a batch whose texts have TOGETHER characters, or one text that is longer."""
    lo, n = 0, 0
    for k, t in enumerate(batch.column("text").to_pylist()):
        n += len(t or "") + 16
        if n >= TOGETHER:
            yield batch.slice(lo, k + 1 - lo)
            lo, n = k + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def encoded(docs: DataFrame, *, path: str = MODEL, seed: int = 11, dropout: float = 0.1, variants: int = VARIANTS, id_col: str = "doc_id", copy_col: str | None = None, by_place: bool = False) -> DataFrame:
    """(_row, variant int, ids array<int>, lossless boolean): the rows of docs with their pieces, and whether decoding gave the text back.

    A document's variant hashes the seed, its id and, if copy_col is given, its copy's number, or, if by_place, its place in
    the scan (which must be deterministic), so copies differ and a rerun gives the same pieces; rows that agree in all of
    these share a variant. Null texts are empty and have no ids.
    An empty table gives an empty table. Texts of about a million characters, or one longer text, are in memory at a time,
    beside the cache, which is bounded by CACHE words.
    """
    rows = packed(docs, "text").withColumn("variant", variant_of(seed, variants, *[F.col(f"_row.`{c}`") for c in (id_col, copy_col) if c], *([F.monotonically_increasing_id()] if by_place else [])))
    schema = rows.select("_row", "variant").schema.add("ids", T.ArrayType(T.IntegerType())).add("lossless", "boolean")

    def run(batches):
        e = encoder(path, seed, dropout)
        for batch in batches:
            for b in _together(batch):
                texts = b.column("text").to_pylist()
                ids = [x for x, _ in e.encode_many(texts, b.column("variant").to_pylist())]
                same = [e.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("variant"), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(same)], names=["_row", "variant", "ids", "lossless"])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, *, path: str = MODEL, seed: int = 11, dropout: float = 0.1, variants: int = VARIANTS) -> DataFrame:
    """doc_id, n_tokens, n_tokens_full (without dropout), variant, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, lossless: encoded() without the ids themselves leaving the task."""
    rows = docs.select("doc_id", "text").withColumn("_variant", variant_of(seed, variants, F.col("doc_id")))

    def run(batches):
        e = encoder(path, seed, dropout)
        for batch in batches:
            for b in _together(batch):
                rows = []
                ids, texts, variant = (b.column(c).to_pylist() for c in ("doc_id", "text", "_variant"))
                for i, t, v, (x, full) in zip(ids, texts, variant, e.encode_many(texts, variant), strict=True):
                    back = e.decode(x)
                    rows.append((i, len(x) // 4, full, v, hashlib.sha256(x).hexdigest(), hashlib.sha256(back).hexdigest(), back == (t or "").encode("utf-8", "surrogatepass")))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "n_tokens_full", "variant", "ids_sha256", "decoded_sha256", "lossless"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_full long, variant int, ids_sha256 string, decoded_sha256 string, lossless boolean")


def op3(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
