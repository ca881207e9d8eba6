import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lamina.functions import plates


def said(text):
    """The grammar's rules in plain words, for comparison."""
    preferred, valid = re.compile(r"[0-9]{2}[A-Z][0-9]{4,6}"), re.compile(r"[0-9]{2}[A-Z][A-Z0-9]?[0-9]{3,5}")
    text = re.sub("[^A-Z0-9]", "", text.upper())
    to_digit, to_letter = dict(zip("BGILOSZT", "86110521", strict=True)), dict(zip("014568", "GLASGB", strict=True))

    def swapped(places):
        return "".join(to_letter.get(c, c) if i in places else to_digit.get(c, c) for i, c in enumerate(text))

    def single(t):
        shorter = t[:3] + t[4:]
        return shorter if len(t) == 9 and t[3].isdigit() and t[3] == t[4] and (preferred.fullmatch(shorter) or valid.fullmatch(shorter)) else t

    found = [single(t) for t in (text, swapped({2}), swapped({2, 3}))]
    return next((t for t in found if preferred.fullmatch(t)), next((t for t in found if valid.fullmatch(t)), text))


def test_known_plates(spark):
    cases = {"51F12345": "51F12345", "5IF12345": "51F12345", "51-F-123.45": "51F12345", "": "", "AB": "AB", "59S212345": "59S212345", "59S112345": "59S12345"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", plates.corrected(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == cases


def test_random_strings_agree_with_the_rules(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0145689ABGILOSTZ-.") for _ in range(rng.randint(0, 11))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plates.corrected(F.col("t")).alias("c")).collect()
    assert [(r["t"], r["c"]) for r in rows if r["c"] != said(r["t"])] == []


def test_doubled_series_can_be_kept(spark):
    row = spark.createDataFrame([("59S112345",)], "t string").select(plates.corrected(F.col("t"), drop_doubled=False).alias("c")).first()
    assert row["c"] == "59S112345"


@pytest.mark.parametrize(("text", "two", "top", "score"), [("51F12345", False, 0, 11.0), ("59S212345", True, 4, 3 + 1 + 1 + 3 + 2 + 4 + 2), ("", False, 0, -3.0), ("AB", False, 0, -3.0)])
def test_format_score(spark, text, two, top, score):
    row = spark.createDataFrame([(text, two, top)], "t string, two boolean, n int").select(plates.format_score(F.col("t"), F.col("two"), F.col("n")).alias("s")).first()
    assert row["s"] == score


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=12))
def test_normalised_text_is_stable(spark, text):
    out = spark.createDataFrame([(text,)], "t string").select(plates.normalised(F.col("t")).alias("a")).select("a", plates.normalised(F.col("a")).alias("b")).first()
    assert out["a"] == out["b"] and re.fullmatch("[A-Z0-9]*", out["a"])


def test_null_text_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(plates.corrected(F.col("t")).alias("c")).first()["c"] is None
