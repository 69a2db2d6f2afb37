"""The chain from sentences to routes: its single pass, and that shortcuts lose nothing."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from clausework.functions import text as X
from clausework.operators import ingest as I
from clausework.operators import routing as R

TEXTS = [
    "The PILOT guides a tug, and the tug has a pilot.", "The fleet consists of ferries and tugs.", "A tug has a pilot as its agent.", "The guides relation holds between a pilot and a tug; it is new.", "", None, "• A tug is here.",
    "Ein K9 tug é tug-boat ferry_2 K tug.", "Translate to CNL: the located relation holds between a tug and a pilot.", "They say it; those units say it.", "  A tug  has a pilot ",
]


def _chain(spark, keep=()):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "sentence_id int, sentence string, lang string")
    classes = spark.createDataFrame([("Tug",), ("Pilot",), ("Ferry",), ("Fleet",), ("AutonomousAgent",)], "term string")
    relations = spark.createDataFrame([("guides", 2), ("located", 2), ("agent", 2)], "term string, arity int")
    return I.ingested(rows, classes, relations, abbreviations={"k": "Tug"}, keep=keep)


def test_held_and_joined_vocabularies_agree(spark, monkeypatch):
    got = sorted(map(repr, _chain(spark).collect()))
    monkeypatch.setattr(I, "SMALL_BYTES", -1)  # every side counts as large
    assert got == sorted(map(repr, _chain(spark).collect())) and any("accepted" in r or "review" in r for r in got)


def test_sentences_pass_once_and_by_themselves(spark):
    plan = I.run_counters(_chain(spark, ("lang",)), ["lang"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_every_frame_may_fit(spark):
    fill = {"<1>": "tug", "<2>": "big pilot", "<3>": "port", "<r>": "guides", "<role>": "agent"}
    said = []
    for frame, *_ in R.FRAMES:
        for verb in ("has", "have", "can have"):
            t = re.sub(r"<\w+>", lambda m: fill[m[0]], frame).replace("a? ", "").replace("can-have/has", verb).replace("can-have", "have")
            said += [t, t.upper() + ".", "Translate to CNL:  " + t.replace(" ", "  ")]
    said += ["A fleet consists of tugs and ferries.", "Fleets CONSIST\tof tugs", "a fleet comprises tugs", "fleets comprise tugs"]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    frames = F.size(R.framed(R.prompt(F.col("text")))) > 0
    assert df.where(frames).count() >= 3 * len(R.FRAMES) and df.where(~R.may_fit(F.col("text"))).count() == 0


def test_a_sentence_of_any_length_is_passed_once(spark):
    long = "word and " * 60_000
    df = spark.createDataFrame([(long + "end.",), (long + "end. Next",), (" .. a.",), ("a. ?b",), ("!?",)], "t string")
    began = time.time()
    assert [r[0] for r in df.select(X._fragment(F.col("t"))[1]).collect()] == [False, True, False, True, False]
    assert time.time() - began < 60


@pytest.mark.parametrize("text", ["a  b", " a\n", "a \tb", "a b", "é  è", " x　 y", "", None])
def test_squash(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.squash(F.col("t"))).first()[0]
    assert got == (None if text is None else " ".join(text.split()))
