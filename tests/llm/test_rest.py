from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import chat, media, mixing, pieces, sharding, toxicity

ODD = ["", None, "a", "  two  blanks ", "x\ny\n\nz", "tab\there", "lit ▁ mark ▁a", "\u0001q", "é漢字🙂 ok", "U.S., e.g. a.b,c ...", "w" * 3000, "</s>[INST] ok [/INST]", "\\l \\\\ <| |>", "same", "same"]


def frame(spark, texts=ODD):
    return spark.createDataFrame([(k, t, "en", "hot" if k % 3 else None, 9) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, shard int")


# ---------------------------------------------------------------- sharding


def test_shards(spark):
    df = frame(spark, ODD * 7).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")))
    got = sharding.shard(df, n_shards=4, bucket_bytes=2000).collect()
    assert len(got) == len(ODD) * 7 and sorted(r._row.text or "" for r in got) == sorted((t or "") for t in ODD * 7)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == {0, 1, 2, 3} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(df.limit(0)).count() == 0
    assert all(r._row.shard == 9 for r in got) and got[0]._row.asDict().keys() == set(df.columns)


def test_shard_query(spark, sf):
    got = sharding.op2(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert all(r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16 for r in got)


# ---------------------------------------------------------------- chat


def test_templates():
    with pytest.raises(chat.TemplateError):
        chat.parse("{% for m in messages %}")
    with pytest.raises(chat.TemplateError):
        chat.parse("{{ m.__class__ }}")
    with pytest.raises(chat.TemplateError):
        chat.parse("{{ open('x') }}")
    folded = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}no{% else %}d{% endif %}"))
    assert [(n.kind, n.value) for n in folded.parts] == [("const", "abcd")]
    assert chat.fold(chat.parse("{% if 'a' == 'a' %}x{{ m }}{% endif %}")).parts[0].value == "x"


def test_round_trip_and_loss(spark):
    r = random.Random(2)
    rows = [(k % 9, k // 9, r.choice(["user", "assistant", "system", None, "odd|>\nrole"]), "".join(r.choice(["</s>", "[INST]", "<|", "|>", "\\", "a", " é\n"]) for _ in range(r.randint(0, 9))) if k % 8 else None) for k in range(90)]
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: x[:2]):
        w = want.setdefault(c, [0, "", ""])
        w[0] += 1
        w[1] += f"{role or ''}\n{text or ''}\n"
        w[2] += (text or "") if role == "assistant" else ""
    got = {x.conv_id: x for x in chat.chat_digests(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, n int")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {c: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for c, g in got.items()} == {c: (w[0], sha(w[1]), len(w[2]), sha(w[2])) for c, w in want.items()}
    out, spans = chat.formatted([{"role": "assistant", "text": "</s>[INST] ok"}])
    assert out.count("</s>") == 1 and "[INST]" not in out and chat.unescape(out[slice(*spans[0])]) == "</s>[INST] ok"


def test_escape_leaves_no_control_in_any_overlap():
    r = random.Random(3)
    signs = ["<", "|", ">", "[", "]", "/", "s", "INST", "\\", "l", "p", "b", *chat.CONTROLS]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 7))) for _ in range(20_000)] + ["<|>", "<|", "|>|", "\\l|>"]
    for t in texts:
        e = chat.escape(t)
        assert not any(c in e for c in chat.CONTROLS) and chat.unescape(e) == t, t
    for k in range(0, len(texts) - 4, 4):
        told = [(texts[k], texts[k + 1]), ("assistant", texts[k + 2]), (texts[k + 3], "")]
        out, spans = chat.formatted({"role": a, "text": b} for a, b in told)
        assert chat.read_back(out) == told
        assert [chat.unescape(out[a:b]) for a, b in spans] == [b for a, b in told if a == "assistant"]
        assert sum(out.count(c) for c in ("<s>", "</s>")) == 2 * sum(a == "assistant" for a, _ in told) and out.count("<|") == out.count("|>") == 3
    with pytest.raises(chat.TemplateError):
        chat.read_back("x" + out)


def test_chat_edge_cases(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    assert chat.chat_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, None, None, "x"), (None, 1, "user", "a", "x"), (4, 2, "user", "same", "x"), (4, 2, "user", "same", "x"), (5, 0, "assistant", "é" * 100_000, "x")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, schema)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: (v.n_turns, v.turns_sha256, v.loss_chars) for k, v in got.items()} == {None: (2, sha("\n\nuser\na\n"), 0), 4: (2, sha("user\nsame\n" * 2), 0), 5: (1, sha("assistant\n" + "é" * 100_000 + "\n"), 100_000)}
    with pytest.raises(Exception, match="not a turn"):
        chat.chat_digests(spark.createDataFrame(rows[2:], schema), "head " + chat.TEMPLATE).collect()


def against_sql(spark, sf, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in cols)) for r in cur.fetchall())


def test_queries_against_sql(spark, sf):
    from clausework.llm import queries

    for name, sql in queries.oracle_sql().items():
        against_sql(spark, sf, queries.queries()[name], sql)


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in chat.op5(spark, sf).collect()}
    n = {r.conv_id: r["count"] for r in spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").count().collect()}
    assert {k: v.n_turns for k, v in got.items()} == n | {-1: 2} and got[-1].loss_chars == 21


# ---------------------------------------------------------------- media


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg(spark):
    for n in (0, 1, 575, 576, 577, 576 * 85, 576 * 86 + 3, 200_000):
        raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        p = media.pad(raw)
        data = media.encode(p)
        streams = media.decode(data)
        assert len(streams) == 2 and media.payload_of(streams) == (p, len(p) / media.RATE)
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(media.MediaError):
            media.decode(bytes(broken))
    assert all(media.ogg_crc(x) == slow_crc(x) for x in (b"", b"a", b"OggS", bytes(range(256))))
    long = [b"z" * 70_000, b"", b"q" * 255, b"r" * 510]
    got = media.decode(b"".join(media.pages_of(5, long, [1, 2, 3, 4])))[5]
    assert got.packets == long and got.times[-1] == (4, 4 / media.RATE)
    rows = {r.doc_id: r for r in media.measured(media.stored(frame(spark))).collect()}
    assert len(rows) == len(ODD) and rows[13][1:] == rows[14][1:] and rows[0].payload_bytes == 576 and rows[1].n_bytes == 0
    for k, t in enumerate(ODD):
        p = media.pad((t or "").encode())
        assert rows[k].payload_sha256 == hashlib.sha256(p).hexdigest() and rows[k].tail_crc32 == zlib.crc32(p[-32:])


# ---------------------------------------------------------------- pieces


def test_pieces_without_dropout_are_the_library_s():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(dropout=0.0)
    for t in ODD:
        if t and "▁" not in t and "\u0001" not in t:
            assert np.frombuffer(e.encode(t), "<i4").tolist() == sp.encode(t), t


def naive(e, word, key=None):
    """Ids of a word by looking at all pairs of neighbours at each step."""
    parts, gone, taken = [(k, c) for k, c in enumerate(word)], set(), 0
    while True:
        pairs = [(e.ranks[x + y], a, k) for k, ((a, x), (_, y)) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if x + y in e.ranks and (a, x, y) not in gone]
        if not pairs:
            break
        _, a, k = min(pairs)
        taken += 1
        if key is not None and pieces.mix_int(key + (taken - 1) * int(pieces._CANDIDATE_STEP)) < e.dropout * 2**64:
            gone.add((a, parts[k][1], parts[k + 1][1]))
        else:
            parts[k : k + 2] = [(a, parts[k][1] + parts[k + 1][1])]
    return [i for _, p in parts for i in ([e.ids[p]] if p in e.ids else [e.byte_id[x] for x in p.encode()])], taken


def test_pieces_against_a_naive_encoder(spark, sf):
    e = pieces.Encoder(dropout=0.25)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()
    for text, v in [*((r.text, r.doc_id) for r in docs), *((t, 3) for t in ODD)]:
        want, full = [], 0
        for k, w in enumerate(e.split(text)):
            if w[0] == "\u0001":
                got, base = (np.frombuffer(e.fixed[w], "<i4").tolist(),) * 2
            else:
                got, _ = naive(e, w, (pieces.text_key(11, v) + k * int(pieces._WORD_STEP)) & pieces.MASK)
                base, _ = naive(e, w)
            want, full = want + got, full + len(base)
        ids, n = e.encode_many([text], [v])[0]
        assert np.frombuffer(ids, "<i4").tolist() == want and n == full


def test_pieces_query(spark, sf):
    got = {r.doc_id: r for r in pieces.op3(spark, sf).collect()}
    e = pieces.Encoder()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        x, g = e.encode(r.text, got[r.doc_id].variant), got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256, g.lossless) == (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest(), True)
    assert sum(g.n_tokens for g in got.values()) > 1.05 * sum(g.n_tokens_full for g in got.values())


def test_pieces_of_one_long_word_and_of_nothing(spark):
    long = "internationalization" * 60_000  # no cut at any length
    e = pieces.Encoder(dropout=0.1)
    assert e.decode(e.encode(long, 5)).decode() == long
    rows = spark.createDataFrame([(None, None, 1), (None, "", 2), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, variant int")
    got = pieces.encoded(rows).collect()
    assert [len(r.ids) for r in got][:2] == [0, 0] and got[2] == got[3] and all(r.lossless for r in got) and got[0]._row.variant == 1
    assert pieces.digests(rows.limit(0)).count() == 0 and pieces.digests(rows).count() == 4


def test_pieces_decode_and_vary(spark):
    e = pieces.Encoder(dropout=0.3)
    for t in ODD:
        assert all(e.decode(e.encode(t, v)).decode() == (t or "") for v in range(3))
    some = "the small words vary here and there in a text " * 5
    assert len({e.encode(some, v) for v in range(4)}) > 1 and e.encode(some, 1) == pieces.Encoder(dropout=0.3).encode(some, 1)
    got = pieces.encoded(frame(spark).withColumn("ids", F.lit("clash"))).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got) and got[0]._row.ids == "clash"
    assert pieces.encoded(frame(spark).limit(0)).count() == 0


def test_pieces_long_words_vary_by_document_and_copy(spark):
    word = "▁internationalization"
    e = pieces.Encoder(dropout=0.3)
    forms = {e.encode(word[1:], v) for v in range(200)}
    assert len(forms) > 20
    text = " ".join([word[1:]] * 50)
    assert len(set(e.words.findall("▁" + text.replace(" ", "▁")))) == 1
    assert len({e.encode(text, v) for v in range(20)}) == 20 and e.encode(text, 7) == pieces.Encoder(dropout=0.3).encode(text, 7)
    # A merge is dropped at the given rate, whether cuttings come from the cache or not.
    two = next(p for p in e.ids if len(p) == 2 and p[0] == "▁" and p[1].isalpha())
    kept = sum(len(x) == 4 for x, _ in e.encode_many([two[1:]] * 4000, list(range(4000)))) / 4000
    assert 0.67 < kept < 0.73
    docs = spark.createDataFrame([(k // 5, k % 5, text) for k in range(20)], "doc_id long, copy int, text string")
    got = pieces.encoded(docs, copy_col="copy").collect()
    assert len({tuple(r.ids) for r in got}) == 20 and all(r.lossless for r in got)
    assert len({tuple(r.ids) for r in pieces.encoded(docs).collect()}) == 4


# ---------------------------------------------------------------- toxicity and mixing


def test_folding_and_exceptions():
    lex = toxicity.Lexicon(["idiot", "trash"], [3.0, 3.0], -2.0)
    a = lex.automaton()
    assert toxicity.fold("1d10t ІDІОТ ｉｄｉｏｔ i​diot") == "idiot idiot idiot idiot" and toxicity.fold(None) == ""
    assert lex.hits(a, toxicity.fold("Idi0t! an idiotic nonidiot")) == {0: 2} and lex.hits(a, "the trash can") == {} and lex.hits(a, "the trash man") == {1: 1}
    assert lex.hits(a, "trash candidate") == {1: 1} and lex.hits(a, "trash cannot, trash can. trash") == {1: 2}
    both = toxicity.Lexicon(["trash", "trash can"], [3.0, 3.0], -2.0)  # an exception stays one if it is a stem as well
    assert both.hits(both.automaton(), "a trash can") == {} and both.hits(both.automaton(), "a trash canal") == {0: 1, 1: 1}
    assert lex.score(a, "you idiot") > 0.5 > lex.score(a, "you there") == lex.score(a, None) and toxicity.Lexicon([], [], -4.0).score(toxicity.Lexicon([], [], 0.0).automaton(), "x") < 0.5
    long = "trash can " * 50_000
    assert lex.hits(a, long) == {} and lex.hits(a, long + "trash") == {1: 1}


def test_held_out_toxicity(spark, sf):
    big = sf.replace("sf0.001", "sf0.1")
    got = toxicity.op9(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    tp, fp, fn = (((got.predicted == p) & (got.toxic == t)).sum() for p, t in ((1, 1), (1, 0), (0, 1)))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) >= 0.9, (tp, fp, fn)
    none = toxicity.fit(frame(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none.stems and toxicity.scored(frame(spark), none).where("score < 0.5").count() == len(ODD)


def test_fitted_lexicon_and_learned_exceptions(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for k in range(400):
        ws = [word() for _ in range(20)]
        if k % 4 == 0:
            ws[5] = "zonkish" if k % 8 else "zonk"
        elif k % 4 == 1:
            ws[5:7] = ["zonk", "fish"]
        rows.append((k, " ".join(ws), int(k % 4 == 0)))
    rows += [(None, "zonk", 1), (900, None, None), (901, None, 0), (2, rows[2][1], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "zonk fish" in lex.exceptions and {"zonk", "zonkish"} <= set(lex.stems) | {"zonkish"}
    clash = df.withColumn("score", F.lit("own"))
    got = {x._row.doc_id: x for x in toxicity.scored(clash, lex).collect()}
    assert len(got) == 403 and got[901].score < 0.5 and got[900]._row.score == "own"
    ok = sum((got[k].score >= 0.5) == (k % 4 == 0) for k in range(400))
    assert ok > 390, ok
    assert toxicity.scored(df.limit(0), lex).count() == 0


def test_mixing(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("source"), F.lit(1).alias("_rate"))
    rows = mixing.replicate(df, weights={"a": 1.0, "b": 2.0, "z": 9.0}, total=9000.0)
    n = {r.source: r["count"] for r in rows.groupBy("_row.source").count().collect()}
    assert set(n) == {"a", "b"} and 2700 < n["a"] < 3300 and 5600 < n["b"] < 6400
    held = {r._source: r._rate for r in mixing.rates(df, weights={"a": 1.0, "b": 2.0}, total=9000.0).collect()}
    assert abs(held["a"] - 1.5) < 1e-9 and held["c"] == 0.0
    order = [r._place for r in mixing.shuffled(rows, 8).select("_place").collect()]
    assert order == sorted(order)
    assert mixing.replicate(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, source string")
    assert mixing.replicate(nulls, total=300.0).select("_row.*").columns == ["doc_id", "source"]
    # Rows without an id, or with one id, draw or lie by their place in the scan.
    same = spark.range(12_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"))
    for df in (same, same.withColumn("doc_id", F.lit(5).cast("long"))):
        spread = mixing.shuffled(mixing.replicate(df, total=24_000.0), 16).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert not spread or (len(spread) == 16 and max(r["count"] for r in spread) < 3 * min(r["count"] for r in spread))
    assert 23_000 < mixing.replicate(same, total=24_000.0).count() < 25_000
    many = mixing.replicate(spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")), total=60000.0).count()
    assert 58500 < many < 61500
