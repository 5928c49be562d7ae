"""A stream run over arriving files equals one batch over all of them."""

import pandas as pd
from pyspark.sql import functions as F

from docengine.operators.chunking import chunk_documents, sequential_chunks
from docengine.operators.ingest import ingest_documents
from docengine.plans.queries import QUERIES
from docengine.schemas import BRONZE
from docengine.streaming import ingest as st
from docengine.streaming.changes import ChunkChanges


def bronze(batch):
    pages = F.array(F.decode("content", "utf-8"))
    return ingest_documents(batch.select("path", pages.alias("pages")))


def test_two_runs_see_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in" / "sub").mkdir(parents=True)

    def run():
        st.ingest_stream(st.stream_files(spark, source), bronze, target, checkpoint).awaitTermination()
        return {r["file_name"]: r["year"] for r in st.read_ingested(spark, target, BRONZE).collect()}

    (tmp_path / "in" / "a.pdf").write_text("May 2020")
    assert run() == {"a.pdf": "2020"}
    (tmp_path / "in" / "sub" / "b.pdf").write_text("May 2021")
    assert run() == {"a.pdf": "2020", "b.pdf": "2021"}
    assert run() == {"a.pdf": "2020", "b.pdf": "2021"}
    assert st.read_ingested(spark, target, BRONZE).count() == 2


def test_upsert_keeps_the_latest_row_and_compacts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = spark.createDataFrame([], "file_name string, text string").schema

    def gold(batch):
        return chunk_documents(batch, sequential_chunks(F.col("text"), 10, 5)).select("uuid", "content")

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = st.stream_rows(spark, source, schema, "*.parquet")
        st.upsert_stream(stream, gold, target, checkpoint).awaitTermination()
        now = st.current_rows(spark, target, gold(spark.createDataFrame([], schema)).schema)
        return {r["uuid"]: r["content"] for r in now.collect()}

    assert arrive([("a", "one"), ("b", "two")]) == {"a_0": "one", "b_0": "two"}
    assert arrive([("b", "deux"), ("c", "three")]) == {"a_0": "one", "b_0": "deux", "c_0": "three"}
    chunk_schema = gold(spark.createDataFrame([], schema)).schema
    st.compact(spark, target, chunk_schema, str(tmp_path / "compact"))
    kept = st.current_rows(spark, str(tmp_path / "compact"), chunk_schema)
    assert kept.count() == 3


def test_rows_that_an_owner_no_longer_has_go(spark, tmp_path):
    target = str(tmp_path / "log")
    columns = "path string, uuid string, content string"
    brought = [
        [("/a/x", "x_0", "one"), ("/a/x", "x_1", "two"), ("/b/x", "x_0", "other"), ("/c", "c_0", "c")],
        [("/a/x", "x_0", "short"), ("/c", None, None)],
    ]
    for number, rows in enumerate(brought):
        made = spark.createDataFrame(rows, columns)
        logged = st.with_tombstones(made.filter("uuid is not null"), made, "path")
        logged.write.parquet(f"{target}/batch_id={number}")
    schema = spark.createDataFrame([], columns).schema
    now = st.current_rows(spark, target, schema, owner="path")
    assert sorted(tuple(r) for r in now.collect()) == [("/a/x", "x_0", "short"), ("/b/x", "x_0", "other")]


def test_documents_in_one_file_or_in_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"Text {i}.\nMay 20{i}", "en", "src1", 1) for i in range(10, 16)] + [(5, None, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "one" / "documents.parquet")
    for name in ("stream_ingest", "stream_sync"):
        one, many = (sorted(map(str, QUERIES[name](spark, str(tmp_path / kind)).collect())) for kind in ("one", "many"))
        assert len(one) >= 6 and one == many


def test_a_document_costs_the_state_few_messages():
    """However many chunks a document has; the rows are those of a state entry per chunk."""
    calls = []

    class Held(dict):
        def exists(self):
            return bool(calls.append("exists") or self)

        def iterator(self):
            calls.append("iterator")
            return iter(self.items())

        def getValue(self, key):
            calls.append("get")
            return self.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            self[key] = value

        def removeKey(self, key):
            calls.append("remove")
            del self[key]

    held = Held()
    processor = ChunkChanges()
    processor.init(type("Handle", (), {"getMapState": lambda *_: held})())

    def run(*rows):
        calls.clear()
        columns = ["owner", "version", "uuid", "content", "digest"]
        parts = [pd.DataFrame(rows[i : i + 70], columns=columns) for i in range(0, len(rows), 70)]
        out = pd.concat(list(processor.handleInputRows((1,), iter(parts), None)))
        return [tuple(r) for r in out[["uuid", "content", "_change_type"]].values.tolist()]

    first = [("a", 1, f"a_{i}", f"x{i}", f"d{i}") for i in range(100)]
    assert run(*first) == [(f"a_{i}", f"x{i}", "insert") for i in range(100)]
    assert len(calls) <= 3
    assert run(*first) == [] and len(calls) <= 3
    later = [("a", 2, f"a_{i}", None if i == 5 else f"x{i}", "new" if i == 5 else f"d{i}") for i in range(99)]
    assert run(*first[:50], *later, *first[50:]) == [("a_5", None, "update"), ("a_99", None, "delete")]
    assert len(calls) <= 3
    assert run(("a", 3, None, None, "d")) == sorted((f"a_{i}", None, "delete") for i in range(99)) and not held
    assert run(("b", 1, "b_0", "x", "d"), ("b", 1, "b_0", "x", "d"), (None, 1, None, None, "d")) == [("b_0", "x", "insert")] * 2
