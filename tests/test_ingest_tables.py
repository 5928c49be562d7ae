import statistics
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.operators import changes, ingest
from docengine.operators.profile import profile
from docengine.schemas import BRONZE, GLOSSARY
from docengine.session import work_folder
from docengine.sources import files, tables

EXTRACTED = "path string, pages array<string>, text string, error string"


def bronze_of(spark, rows, **kwargs):
    df = ingest.ingest_documents(spark.createDataFrame(rows, EXTRACTED), **kwargs)
    assert df.schema.fieldNames() == BRONZE.fieldNames()
    assert [f.dataType for f in df.schema] == [f.dataType for f in BRONZE]
    return {r["file_name"]: r for r in df.collect()}


def test_rows_of_every_kind(spark):
    got = bronze_of(
        spark,
        [
            ("/v/a/One.PDF", ["May 2020", "", "June 1999"], None, None),
            ("/v/two.pdf", ["no date", "in June 1999"], "given text", None),
            ("/v/three.docx", ["x"], None, None),
            ("/v/four.pdf", None, None, "broken"),
            ("/v/five.pdf", [], None, None),
            ("/v/noext", ["x"], None, "broken"),
        ],
    )
    one = got["One.PDF"]
    assert (one["file_extension"], one["num_pages"], one["year"]) == (".pdf", 3, "2020")
    assert one["text"] == "May 2020\nJune 1999" and one["length"] == len(one["text"])
    assert (got["two.pdf"]["text"], got["two.pdf"]["year"]) == ("given text", "1999")
    three = got["three.docx"]
    assert three["text"] == "Unsupported file type: .docx" and three["length"] == 28
    assert (three["status"], three["num_pages"], three["year"]) == ("unsupported", None, None)
    four = got["four.pdf"]
    assert (four["text"], four["length"]) == ("Error processing file: broken", 0)
    assert (four["status"], got["five.pdf"]["status"]) == ("error", "error")
    assert got["noext"]["text"] == "Unsupported file type: "


def test_clean_flag(spark):
    rows = [("/v/a.pdf", ["Published on\nMay 2021, sent in June 1999"], None, None)]
    assert bronze_of(spark, rows, clean=True)["a.pdf"]["year"] == "2021"
    assert bronze_of(spark, rows, clean=False)["a.pdf"]["year"] == "1999"


def test_scan_extract_and_new_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Report one.PDF").write_text("Publication date: 2 May 2022")
    (tmp_path / "sub" / "report two.pdf").write_text("nothing")
    (tmp_path / "sub" / "_hidden.pdf").write_text("skipped")

    @F.pandas_udf("struct<pages:array<string>,text:string,error:string>")
    def read(paths, contents):
        import pandas as pd

        return pd.DataFrame(
            {"pages": [[c.decode()] for c in contents], "text": None, "error": None}
        )

    scanned = files.scan_files(spark, str(tmp_path))
    listing = files.list_files(scanned)
    assert sorted(r["file_name"] for r in listing.collect()) == ["report one.pdf", "report two.pdf"]
    rows = ingest.ingest_documents(ingest.extract_pages(scanned, read)).collect()
    assert {r["file_name"]: r["year"] for r in rows} == {"Report one.PDF": "2022", "report two.pdf": None}
    processed = spark.createDataFrame([("REPORT TWO.pdf",), ("REPORT TWO.pdf",)], "file_name string")
    left = ingest.new_files(listing, processed).collect()
    assert [r["file_name"] for r in left] == ["report one.pdf"]
    # listing does not read contents
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_sinks(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.overwrite_table(first, name, str(tmp_path / "t"))
    tables.append_table(spark.createDataFrame([("b", 2)], "s string, n int"), name, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, "b")]
    tables.overwrite_table(first, name, str(tmp_path / "t"))
    assert spark.table(name).count() == 1

    merged = tables.merge_schema(first, spark.createDataFrame([("x", 1.5)], "s string, d double"))
    assert merged.columns == ["n", "s", "d"] and [tuple(r) for r in merged.collect()] == [(None, "x", 1.5)]

    glossary = f"g_{uuid.uuid4().hex}"
    for _ in range(2):
        tables.create_table_if_absent(spark, glossary, GLOSSARY, str(tmp_path / "g"))
    rows = spark.createDataFrame([("CBA", "Cost Benefit Analysis", 100, "f")],
                                 "acronym string, definition string, certainty int, file_name string")
    assert tuple(tables.insert_rows(rows, glossary).first()) == ("f", "CBA", "Cost Benefit Analysis", 100)
    for table in (name, glossary):
        spark.sql(f"DROP TABLE {table}")


def test_changes_round_trip(spark):
    import random

    rng = random.Random(3)
    some = lambda: [(f"k{i}", rng.choice(["a", "b", None]), rng.choice([1, None]))
                    for i in range(300) if rng.random() < 0.8]
    old, new = (spark.createDataFrame(some(), "uuid string, content string, n int") for _ in "12")
    diff = changes.snapshot_diff(old, new)
    kinds = {r["_change_type"] for r in diff.select("_change_type").distinct().collect()}
    assert kinds == {"insert", "delete", "update_preimage", "update_postimage"}
    back = changes.apply_changes(old, diff)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, new.collect()))
    assert changes.snapshot_diff(new, new).count() == 0


def test_sync_embeds_only_changed_rows(spark):
    old = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "three")], "uuid string, content string")
    new = spark.createDataFrame([("a", "one"), ("b", "deux"), ("d", "four")], "uuid string, content string")
    mark = lambda label: lambda df: df.withColumn("v", F.lit(label))
    index = changes.sync_index(mark("old")(old), changes.snapshot_diff(old, new), mark("new"))
    assert sorted(tuple(r) for r in index.collect()) == [
        ("a", "one", "old"), ("b", "deux", "new"), ("d", "four", "new")
    ]


def test_stored_index_is_created_then_synced(spark):
    schema = "uuid string, content string"
    name = f"index_{uuid.uuid4().hex}"
    mark = lambda label: lambda df: df.withColumn("v", F.lit(label))

    def synced(rows, label):
        index = changes.create_or_sync(spark.createDataFrame(rows, schema), name, mark(label))
        return sorted(((r["uuid"], r["content"], r["v"]) for r in index.collect()), key=str)

    assert synced([("a", "one"), ("b", ""), ("c", None)], "1") == [
        ("a", "one", "1"), ("b", "", "1"), ("c", None, "1")
    ]
    # An empty text and none at all differ; what is the same keeps its vector.
    assert synced([("a", "one"), ("b", None), ("d", "four")], "2") == [
        ("a", "one", "1"), ("b", None, "2"), ("d", "four", "2")
    ]
    assert synced([("a", "one"), ("b", None), ("d", "four")], "3")[1] == ("b", None, "2")
    assert synced([], "4") == []
    spark.sql(f"DROP TABLE {name}")


def test_merging_append(spark, tmp_path):
    place = str(tmp_path / "merged")
    tables.append_merging(spark.createDataFrame([(1, "x")], "a int, b string"), place)
    merged = tables.append_merging(spark.createDataFrame([(2, 0.5)], "a int, c double"), place)
    assert sorted((r["a"], r["b"], r["c"]) for r in merged.collect()) == [(1, "x", None), (2, None, 0.5)]


def test_changes_over_differing_columns(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "uuid string, gone int")
    new = spark.createDataFrame([("a", "x"), ("c", None)], "uuid string, came string")
    feed = changes.snapshot_diff(old, new)
    got = sorted((r["uuid"], r["_change_type"], r["gone"], r["came"]) for r in feed.collect())
    assert got == [
        ("a", "update_postimage", None, "x"), ("a", "update_preimage", 1, None),
        ("b", "delete", 2, None), ("c", "insert", None, None),
    ]
    applied = changes.apply_changes(old, feed)
    assert sorted(r["uuid"] for r in applied.collect()) == ["a", "c"]


def test_duplicate_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "uuid string")
    assert [tuple(r) for r in changes.duplicate_keys(rows).collect()] == [("a", 2)]


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 9], list(range(-50, 9000, 7)) + [4] * 3000])
def test_profile(spark, values):
    rows = spark.createDataFrame([(v, v % 3) for v in values] + [(None, 1)], "x int, y int")
    got = {r["column_name"]: r for r in profile(rows, ["x", "y"]).collect()}
    x = got["x"]
    assert (x["count"], x["min"], x["max"]) == (len(values), min(values), max(values))
    assert x["mean"] == pytest.approx(statistics.mean(values))
    if len(values) > 1:
        assert x["std"] == pytest.approx(statistics.stdev(values))
    else:
        assert x["std"] is None
    assert [x["p25"], x["p50"], x["p75"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))
    assert got["y"]["count"] == len(values) + 1


def test_profile_of_fractions_and_wide_integers(spark):
    prices = [0.5, 1.5, 2.9, 1e9, float("nan")]
    wide = [-(2**63), 2**63 - 1, 0, 5, 5]
    rows = spark.createDataFrame(list(zip(prices, wide)), "price double, wide bigint")
    got = {r["column_name"]: r for r in profile(rows, ["price", "wide"]).collect()}
    price = got["price"]
    assert (price["count"], price["min"], price["max"]) == (4, 0.5, 1e9)
    assert price["mean"] == pytest.approx(statistics.mean(prices[:4]))
    assert price["std"] == pytest.approx(statistics.stdev(prices[:4]))
    quartiles = [price["p25"], price["p50"], price["p75"]]
    assert quartiles == pytest.approx(list(np.percentile(prices[:4], [25, 50, 75])))
    assert (got["wide"]["count"], got["wide"]["p50"], got["wide"]["max"]) == (5, 5.0, 2.0**63)
    assert got["wide"]["mean"] == pytest.approx(9 / 5)


class Session:
    """As much of a session as ``work_folder`` reads."""

    def __init__(self, master, **settings):
        self.sparkContext = self
        self.conf = settings
        self.master = master


def test_work_folder_prefers_the_shared_setting():
    shared = Session("spark://host:7077", **{"spark.checkpoint.dir": "/shared/work/"})
    assert work_folder(shared, "x").startswith("/shared/work/x-")
    assert "docengine-" in work_folder(Session("local[4]"), "x")
    with pytest.raises(ValueError):
        work_folder(Session("spark://host:7077"), "x")
