"""Joins by key that move only rows which may meet, against plain joins."""

from docengine.operators.keys import parted, with_keys, without_keys
from docengine.plans import inputs, queries
from docengine.sources.versioned import VersionedTable


def test_joins_agree_with_plain_ones(spark):
    rows = spark.createDataFrame([(i % 900 if i % 50 else None, i) for i in range(3000)], "k long, n int")
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "k int")
    plain = lambda df: sorted(tuple(r) for r in df.select("n").collect())
    for keys in ([], [None], [3, 3, None, 7, 100_000], [0, 899], list(range(0, 900, 2)), list(range(900))):
        keys = frame(keys)
        assert plain(with_keys(rows, keys, "k")) == plain(rows.join(keys, "k", "left_semi"))
        assert plain(without_keys(rows, keys, "k")) == plain(rows.join(keys, "k", "left_anti"))
    may, never = parted(rows, frame(range(20)), "k")
    assert may.columns == rows.columns and may.count() + never.count() == 3000
    assert may.count() < 3 * 20 * 5


def test_rows_without_later_changes_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = lambda rows: spark.createDataFrame(rows, "uuid string, content string")
        table = VersionedTable.create(frame([(f"k{i}", "x" * 50) for i in range(2000)]))
        table.merge(frame([("k5", "other")]))
        read = table.as_of()
        assert read.count() == 2000 and read.filter("content = 'other'").count() == 1
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and "_bits" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hybrid_synced_writes_the_labelled_texts_once(spark, tmp_path, monkeypatch):
    texts = [(i, f"the grid plan {i} costs {i * 7} in the year", "fr" if i % 3 else "en") for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 4, int(i % 5 == 0)) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "grid plan"), (2, "the year")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    written = []
    real = inputs.materialise
    monkeypatch.setattr(inputs, "materialise", lambda df, label: written.append(label) or real(df, label))
    found = queries.hybrid_synced(spark, str(tmp_path)).collect()
    assert written.count("labelled") == 1
    assert {r["uuid"] for r in found} <= {f"doc_{i}" for i in range(12) if i % 4} and len(found) == 10
