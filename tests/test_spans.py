"""Places of sentences against a plain scan."""

from __future__ import annotations

import random
import re

from clausework.operators import segment as S


def scan(text, first):
    if not text or not first or not text.startswith(first):
        return []
    at = len(first)
    out = [(0, at)]
    while at < len(text) and text[at].isspace():
        at += 1
    ends = [m for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z])", text[at:]) if not text[at:][: m.start()].endswith(("U.S.", "U.K.", "e.g.", "i.e."))]
    cuts = [0, *(m.end() for m in ends), len(text) - at]
    for a, b in zip(cuts, cuts[1:]):
        piece = text[at + a : at + b].rstrip()
        if piece:
            out.append((at + a, at + a + len(piece)))
    return out


def test_places_of_sentences(spark):
    rng = random.Random(3)
    bits = ["A tug", " is", ".", "!", "?", " ", "  ", "\n", "U.S.", " e.g.", "The", "é", "𝒳", " ", "Port", "i.e. ", "x."]
    rows = []
    for i in range(300):
        first = rng.choice(["A tug is here.", "One.", "U.S."])
        rows.append((i, first + "".join(rng.choices(bits, k=rng.randrange(25))), first))
    rows += [(300, None, "a"), (301, "abc", None), (302, "abc", ""), (303, "abc", "b"), (304, "", "a")]
    got: dict[int, list] = {}
    for r in S.spans(spark.createDataFrame(rows, "doc_id int, text string, first string"), "doc_id").orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert rows[r.doc_id][1][r.start : r.end] == r.sentence
    assert got == {i: s for i, t, f in rows if (s := scan(t, f))}


def test_screening_ends_at_the_first_definition(spark):
    rows = spark.createDataFrame([(1, "The tugs wait in port. A tug is a vessel. A port is a place.", "The tugs wait in port."), (2, "If a tug waits it is late.", "If a tug waits it is late.")], "doc_id int, text string, first string")
    got = S.screened(S.spans(rows, "doc_id"), "doc_id").orderBy("doc_id", "n").collect()
    assert [(r.doc_id, r.n, r.reason is None) for r in got] == [(1, 0, False), (1, 1, True), (2, 0, False)]
