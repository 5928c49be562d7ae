"""Quartiles by selection, places of chunks, aligned acronyms, extractors, stream feeds."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import chunking, glossary, profile as module
from docengine.operators.ingest import extract_files
from docengine.operators.profile import profile
from docengine.streaming import changes as feeds
from docengine.streaming.ingest import stream_rows


@pytest.mark.parametrize("at_once, width", [(1 << 20, 0.004), (5, 0.1), (1, 1e-9)])
def test_quartiles_by_selection(spark, monkeypatch, at_once, width):
    monkeypatch.setattr(module, "SORTED_AT_ONCE", at_once)
    monkeypatch.setattr(module, "WIDTH", width)
    rng = random.Random(at_once)
    values = [(rng.choice([None, math.nan, 1.5, rng.gauss(0, 1e9)]), rng.randrange(3 if i % 2 else 10**18), None) for i in range(3000)]
    rows = spark.createDataFrame(values, "d double, n bigint, nothing int").repartition(3)
    got = {r["column_name"]: r for r in profile(rows, ["d", "n", "nothing"], derived=True).collect()}
    assert set(got) == {"d", "n"}
    for name, at in (("d", 0), ("n", 1)):
        held = [v[at] for v in values if v[at] is not None and v[at] == v[at]]
        row = got[name]
        assert row["count"] == len(held) and row["min"] == float(min(held)) and row["max"] == float(max(held))
        assert [row[q] for q in ("p25", "p50", "p75")] == pytest.approx(list(np.percentile(np.array(held, float), [25, 50, 75])), rel=1e-12)
        assert row["std"] == pytest.approx(np.std(np.array(held, float), ddof=1))
    one = profile(spark.createDataFrame([(7,)], "n int"), ["n"]).first()
    assert (one["count"], one["std"], one["p25"], one["p75"]) == (1, None, 7.0, 7.0)
    assert profile(rows.limit(0), ["d", "n"]).count() == 0


def places(text, chunks):
    begun, ended, reach, out = 0, 1, 1, []
    for chunk in chunks:
        at = (text.find(chunk, ended - 1) + 1 or text.find(chunk, begun) + 1) if chunk else 0
        if not at:
            out.append((None, None, None))
            continue
        out.append((at, at + len(chunk), at - reach))
        begun, ended, reach = at, at + len(chunk), max(reach, at + len(chunk))
    return out


def test_places_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunking, "RUN", 3)
    rng = random.Random(1)
    rows = [("", ["a"]), ("abc", []), ("abcabc", ["", "abc", "bca", "x", "abc"]), ("é\U0001f600b", ["\U0001f600", "b"])]
    for _ in range(60):
        text = "".join(rng.choices("ab \n", k=rng.randint(1, 40)))
        cuts = [sorted(rng.sample(range(len(text) + 1), 2)) if len(text) else (0, 0) for _ in range(rng.randint(0, 9))]
        rows.append((text, [text[a:b] for a, b in sorted(map(tuple, cuts))]))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, chunks array<string>")
    got = frame.select("i", chunking.place_chunks(F.col("text"), F.col("chunks")).alias("p")).collect()
    for r in got:
        assert [tuple(p) for p in r["p"]] == places(*rows[r["i"]]), rows[r["i"]]


def aligned(text):
    """The same rule with loops over characters."""
    out = []
    for found in re.finditer(r"\(([A-Z][0-9&-]*[A-Z][A-Z0-9&-]*s?)\)", text):
        before, short = text[: found.start()], found.group(1)
        letters = [c.lower() for c in short if c.isalnum()]
        words = [w for w in re.split(r"[^A-Za-z0-9' -]", before)[-1].split(" ") if w]
        if not before.endswith(" ") or not words:
            continue
        window = " ".join(words[-min(len(letters) + 5, 2 * len(letters)) :])
        at = len(window)
        for i, letter in reversed(list(enumerate(letters))):
            fits = [
                p for p in range(at) if window[p].lower() == letter
                and (i > 0 or p == 0 or not window[p - 1].isalnum())
            ]
            at = fits[-1] if fits else -1
            if at < 0:
                break
        form = window[at:]
        if at >= 0 and len(form) > len(short) and short not in re.split("[ -]", form):
            out.append((short, form))
    return out


def test_alignment_inside_words(spark):
    texts = [
        "We use deoxyribonucleic acid (DNA) and the hidden Markov model (HMM).",
        "See the gross domestic product (GDP), (ABC) alone, or the AB unit (AB).",
        "An electro-cardiogram (ECG) of the patient; extensible markup language (XML).",
        "( (AB) x (CD)", "Nothing here", None,
    ]
    rng = random.Random(2)
    for _ in range(200):
        words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))]
        texts.append(" ".join(words) + " (" + "".join(rng.choices("ABC", k=rng.randint(2, 4))) + ") " + rng.choice(",- "))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = sorted(tuple(r) for r in glossary.align_acronyms(rows).collect())
    expected = sorted((i, *pair) for i, t in enumerate(texts) for pair in aligned(t or ""))
    assert got == expected and (0, "DNA", "deoxyribonucleic acid") in got and len(got) > 60


def test_extractors_report_by_row(spark):
    def extract(path, content):
        for line in content.split(b"\n"):
            if line == b"bad":
                yield {"path": f"{path}/bad", "error": "unreadable"}
            elif line == b"stop":
                raise ValueError("truncated")
            else:
                yield {"pages": [line.decode()]}

    files = spark.createDataFrame(
        [("a", b"one\nbad\ntwo"), ("b", b"three\nstop\nfour"), ("c", b"\n".join([b"x"] * 2000)), ("d", None)], "path string, content binary"
    )
    got = [(r["path"], (r["pages"] or [None])[0], r["error"]) for r in extract_files(files, extract).collect()]
    assert sorted(got, key=str)[:5] == sorted(
        [("a", "one", None), ("a/bad", None, "unreadable"), ("a", "two", None), ("b", "three", None), ("b", None, "ValueError: truncated")], key=str
    )
    assert sum(p == "c" for p, _, _ in got) == 2000
    assert [e[:14] for p, _, e in got if p == "d"] == ["AttributeError"]


def test_feed_of_a_stream_with_restarts(spark, tmp_path):
    schema = "name string, at long, lines array<string>"

    def chunks(rows):
        each = rows.select("name", "at", F.posexplode_outer("lines").alias("n", "content"))
        return each.withColumn("uuid", F.concat("name", F.lit("_"), F.col("n").cast("string")))

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_rows(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "*.parquet", 1)
        feeds.changes_stream(stream, chunks, "name", "at", str(tmp_path / "feed"), str(tmp_path / "checkpoint")).awaitTermination()
        feed = feeds.read_changes(spark, str(tmp_path / "feed"))
        last = feed.agg(F.max("batch_id")).first()[0]
        return sorted((tuple(r) for r in feed.filter(F.col("batch_id") == last).drop("batch_id").collect()), key=str)

    assert run(("a", 1, ["x", "y"]), ("b", 1, ["z"])) == [("a_0", "x", "insert"), ("a_1", "y", "insert"), ("b_0", "z", "insert")]
    assert run(("a", 2, ["x", "new", "more"]), ("a", 1, ["old"]), ("b", 2, ["z"])) == [("a_1", "new", "update"), ("a_2", "more", "insert")]
    assert run(("a", 3, []), ("c", 1, None)) == [("a_0", None, "delete"), ("a_1", None, "delete"), ("a_2", None, "delete")]
    assert run(("a", 4, ["x"])) == [("a_0", "x", "insert")]
