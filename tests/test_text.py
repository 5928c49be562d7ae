import re

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as tx


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(values)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "given, year",
    [
        ("Publication date: ref 30112022", "3011"),
        ("defining a may 12345", "1234"),
        ("Published on\nMay 2021", "2021"),
        ("updated in June 2020, publication DATE: 5 May 2019", "2019"),
        ("published\nin March\nin April 1999 and 2001", "1999"),
        ("On 30 November 2023 we met", "2023"),
        ("november 2023", "2023"),
        ("in the plan, maybe 2020", None),
        ("begins 2020 in May", None),
        ("in May\n2020 in x June 2011", "2011"),
        ("1 May 12", None),
        ("", None),
        (None, None),
    ],
)
def test_year(spark, given, year):
    assert one(spark, tx.extract_year(F.col("v0")), given) == year


def test_year_equals_plain_patterns_on_random_lines(spark):
    """The anchored patterns find what the plain ones find."""
    import random

    rng = random.Random(7)
    words = ["in", "published", "Updated", "May", "june", "maybe", "2020", "12345", "99", "of",
             "\n", "Publication date:", "30", "defining", "."]
    months = tx.MONTHS

    def plain(text):
        found = re.search(r"Publication date:.*?(\d{4})", text, re.I)
        if found:
            return found.group(1)
        found = re.search(
            rf"(published|in|updated).*?\b({months})\b.*?(\d{{4}})", text, re.I
        )
        if found:
            return found.group(3)
        found = re.search(rf"\b\d{{1,2}}\b\s+({months})\s+\d{{4}}|({months})\s+\d{{4}}", text, re.I)
        return re.search(r"\d{4}", found.group(0)).group(0) if found else None

    texts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["y"] for r in rows.select("t", tx.extract_year(F.col("t")).alias("y")).collect()}
    assert got == {t: plain(t) for t in texts}


def test_clean_and_strip(spark):
    assert one(spark, tx.clean_text(F.col("v0")), "a \x1c b\n c  d ") == "a b c d"
    assert one(spark, tx.clean_text(F.col("v0")), "") == ""
    assert one(spark, tx.clean_text(F.col("v0")), None) is None
    assert one(spark, tx.strip(F.col("v0")), "\n  a b\t\n") == "a b"


@pytest.mark.parametrize(
    "name, extension",
    [("a.tar.gz", ".gz"), (".bashrc", ""), ("a.", "."), ("A.B.PDF", ".pdf"), ("a", ""),
     ("..b.txt", ".txt"), ("", "")],
)
def test_extension(spark, name, extension):
    assert one(spark, tx.file_extension(F.col("v0")), name) == extension


def test_windows_cover_the_text(spark):
    text = "añ\n😀" * 1001
    for width, step in ((7, None), (7, 5), (5000, None)):
        found = one(spark, tx.windows(F.col("v0"), width, step), text)
        assert [w["content"] for w in found] == [
            text[w["start"] - 1 : w["start"] - 1 + width] for w in found
        ]
        assert [w["start"] for w in found] == list(range(1, len(text) + 1, step or width))
    assert not one(spark, tx.windows(F.col("v0"), 5), "")
    assert not one(spark, tx.windows(F.col("v0"), 5, 3), "")


def test_long_window_length(spark):
    found = one(spark, tx.windows(F.col("v0"), 720000, 600000), "x" * 857803)
    assert [len(w["content"]) for w in found] == [720000, 257803]


def test_template_is_filled_in_one_pass(spark):
    filled = tx.fill_template("{a}-{b}-{c}{a}", a=F.col("v0"), b=F.col("v1"))
    assert one(spark, filled, "{b}", "x") == "{b}-x-{c}{b}"


def test_json_string(spark):
    import json

    for value in ('a "q" \\ \n é', "", None):
        assert json.loads(one(spark, tx.json_string(F.col("v0")), value)) == value


def test_join_and_length(spark):
    parts = F.array(F.lit("a"), F.lit(""), F.col("v0"), F.lit("b"))
    assert one(spark, tx.join_parts(parts), "") == "a\nb"
    assert one(spark, tx.text_length(F.col("v0")), None) == 0
    assert one(spark, tx.text_length(F.col("v0")), "é😀") == 2
