"""The versioned table: feeds, reads at versions, net changes against snapshot differences."""

import random

from docengine.operators.changes import snapshot_diff
from docengine.plans import inputs
from docengine.sources.versioned import VersionedTable

SCHEMA = "uuid string, content string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_versions_against_dictionaries(spark):
    rng = random.Random(2)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    state = {f"k{i}": (f"k{i}", "text", i) for i in range(30)}
    table = VersionedTable.create(frame(list(state.values())))
    states = [dict(state)]
    for turn in range(4):
        upserts = {k: (k, rng.choice(["text", "other", None]), rng.choice([1, None])) for k in (f"k{rng.randrange(40)}" for _ in range(12))}
        gone = [f"k{rng.randrange(45)}" for _ in range(4)]
        state.update(upserts)
        state = {k: v for k, v in state.items() if k not in gone}
        table.merge(frame(list(upserts.values())), frame([(k, None, None) for k in gone]))
        states.append(dict(state))
        if turn == 1:
            table.compact()
    for version, held in enumerate(states):
        assert rows_of(table.as_of(version)) == rows_of(frame(list(held.values())))
    for a, b in ((0, 4), (1, 3), (2, 2), (3, 4), (-1, 4)):
        old = frame(list(states[a].values()) if a >= 0 else [])
        assert rows_of(table.net_changes(a, b)) == rows_of(snapshot_diff(old, frame(list(states[b].values()))))
    again = VersionedTable.open(spark, table.folder, table.schema)
    assert again.version == 4 and rows_of(again.as_of()) == rows_of(table.as_of())
    again.replace(frame([]))
    assert again.as_of().count() == 0 and table.as_of(4).count() == len(state)


def test_reading_a_range_touches_no_other_version(spark):
    frame = spark.createDataFrame([("a", "x", 1)], SCHEMA)
    table = VersionedTable.create(frame)
    for text in "yz":
        table.merge(spark.createDataFrame([("a", text, 1)], SCHEMA))
    feed = table.changes_between(1, 2)
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_commit_version" in plan
    assert sorted(r["content"] for r in feed.collect()) == ["y", "z"]


def test_rows_that_nothing_replaces_are_read_without_a_shuffle(spark):
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    table = VersionedTable.create(frame(("a", "x", 1), (None, "no key", 2), ("b", "x", 1)))
    assert shuffles(table.as_of()) == 0 and rows_of(table.as_of()) == [("x", 1, "a"), ("x", 1, "b")]
    table.merge(frame(("b", "y", 1), ("c", "x", 3)), frame(("a", None, None)))
    table.compact()
    assert shuffles(table.as_of()) == 0 and rows_of(table.as_of()) == [("x", 3, "c"), ("y", 1, "b")]
    assert table.merge() == 2 and table.changes_between(1).count() == 0 and rows_of(table.as_of()) == rows_of(table.as_of(1))


def test_snapshots_are_read_without_a_shuffle(spark, tmp_path):
    docs = [(i, f"text {i}", lang) for i, lang in enumerate(["fr", "en", None, "fr", "de"])] + [(None, "none", "fr"), (1, "twice", "en")]
    labels = [(0, 0, 0), (1, 1, 1), (1, None, 0), (2, 0, 1), (2, 1, None), (3, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    old, new = inputs.old_and_new(spark, str(tmp_path))
    assert not any("Exchange" in df._jdf.queryExecution().executedPlan().toString() for df in (old, new))
    assert rows_of(old) == sorted([("text 0", "doc_0"), ("text 3", "doc_3"), ("text 4", "doc_4"), ("none", None)], key=str)
    assert rows_of(new) == sorted([("text 1", "doc_1"), ("twice", "doc_1"), ("Version deux. text 3", "doc_3"), ("text 4", "doc_4"), ("Version deux. none", None)], key=str)
