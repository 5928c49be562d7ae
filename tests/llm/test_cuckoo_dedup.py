"""The deduplication index: filters, insertions, deletions, resizing, edge cases."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

pytest.importorskip("docengine.llm")
import oracle  # noqa: E402
from docengine.llm import cuckoo_dedup as module  # noqa: E402
from docengine.llm import queries  # noqa: E402
from docengine.llm.cuckoo_dedup import BLANKS, CuckooFilter, CuckooIndex, exact_duplicates  # noqa: E402


def normalised():
    return F.regexp_replace("text", BLANKS, "")


def digest(text):
    return sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).digest()


def brute(rows):
    """(doc_id, keep_id, group_size, digest) by a dictionary; kept rows per digest: one."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(digest(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(
        ((d, min(groups[digest(t)])[3], len(groups[digest(t)]), digest(t)) for d, t in rows), key=str
    )


def check(found, rows):
    got = found.collect()
    assert sorted(((r[0], r[1], r[2], bytes(r[4])) for r in got), key=str) == brute(rows)
    kept = [bytes(r["digest"]) for r in got if r["kept"]]
    assert sorted(kept) == sorted({digest(t) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def digests(n, seed=0):
    return [sha256(f"{seed}-{i}".encode()).digest() for i in range(n)]


def test_filter_knows_what_it_holds():
    own, others = digests(3000), digests(20_000, 1)
    made = CuckooFilter.of(own)
    assert made.items == 3000 and all(made.contains(*at) for at in made.places(own))
    assert sum(made.contains(*at) for at in made.places(others)) < 20  # 8 slots of 2 ** -16 each
    again = CuckooFilter(made.cells, made.table(), made.items)
    for at in again.places(own[:2000]):
        assert again.delete(*at)
    assert again.items == 1000 and all(again.contains(*at) for at in again.places(own[2000:]))
    assert sum(again.contains(*at) for at in again.places(own[:2000])) < 5


def test_filter_overflows_and_grows():
    own = digests(200)
    small = CuckooFilter(16)
    assert not all(small.insert(*at) for at in small.places(own))
    made = CuckooFilter.of(own, 16)
    assert made.cells >= 64 and all(made.contains(*at) for at in made.places(own))


def some_rows(rng, n, first=0):
    texts = [f"text {i} of\tmany" for i in range(n // 3)] + ["hot one", "hot  one", "", None, "é\xa0x", "éx"]
    return [(first + i, rng.choice(texts) if rng.random() < 0.6 else "hot\none") for i in range(n)]


def test_insertions_deletions_and_reopening(spark, tmp_path):
    rng = random.Random(3)
    index = CuckooIndex.create(spark, 3, str(tmp_path / "index"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    live = []
    for turn in range(3):
        rows = some_rows(rng, 200, 150 * turn)  # some ids come again
        index.insert(frame(rows), normalised())
        live += rows
        check(index.decisions(), live)
        gone = {i for i, _ in rng.sample(live, 60)} if turn < 2 else {i for i, _ in live}
        index = CuckooIndex.open(spark, index.folder)
        index.delete(frame([(i, "x") for i in gone] + [(None, "x")]))
        live = [row for row in live if row[0] not in gone]
        check(index.decisions(), live)
        items = index._filters().agg(F.sum("items")).first()[0] or 0
        assert items == len({digest(t) for _, t in live})
    statuses = {r[0] for r in spark.read.parquet(f"{index.folder}/contents").select("status").distinct().collect()}
    assert {"new", "known"} <= statuses


def test_resizing_from_stored_keys(spark, monkeypatch):
    monkeypatch.setattr(module, "KEYS_PER_BUCKET", 8)
    index = CuckooIndex.create(spark, 16)
    rows = [(i, f"text {i // 2}") for i in range(1500)]
    for part in (rows[:500], rows[500:1000], rows):
        index.insert(spark.createDataFrame(part, "doc_id long, text string"), normalised())
    check(index.decisions(), rows[:1000] + rows)
    assert index.buckets == 2 and index._filters().agg(F.min("cells")).first()[0] >= 64
    assert index._filters().agg(F.sum("items")).first()[0] == 750


def test_false_hits_are_verified(spark, monkeypatch):
    """With fingerprints of three values, most new digests look known."""
    places = CuckooFilter.places

    def few(self, digests):
        step = lambda f: self._step(f) & (self.cells - 1)
        return [(f % 3 + 1, a, a ^ step(f % 3 + 1)) for f, a, _ in places(self, digests)]

    monkeypatch.setattr(CuckooFilter, "places", few)
    index = CuckooIndex.create(spark, 300)
    rows = [(i, f"text {i}") for i in range(300)]
    for part in (rows[:250], rows[200:]):
        index.insert(spark.createDataFrame(part, "doc_id long, text string"), normalised())
    check(index.decisions(), rows[:250] + rows[200:])
    counts = dict(
        spark.read.parquet(f"{index.folder}/contents").groupBy("status").count().collect()
    )
    assert counts["known"] == 50 and counts["false hit"] > 0 and counts["new"] + counts["false hit"] == 300
    index.delete(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index._filters().agg(F.sum("items")).first()[0] == 0


def test_edge_rows(spark):
    schema = "doc_id long, text string, digest int, kept string, row long, version string, bucket long, content int"
    rows = [
        (None, "a b"), (None, "a b"), (3, "ab"), (2, "a b"), (2, "a b"), (4, " \x0b\x0c"), (5, None), (6, ""),
        (7, "w " * 300_000), (8, "w" * 300_000),
    ]
    frame = spark.createDataFrame([(i, t, 1, "k", 2, "v", 3, 4) for i, t in rows], schema)
    check(exact_duplicates(frame), rows)
    check(exact_duplicates(frame, batches=1), rows)
    assert exact_duplicates(frame.limit(0)).count() == 0


def test_query_equals_sql_on_edges(spark, tmp_path):
    rows = some_rows(random.Random(9), 300) + [(None, "hot one"), (5, "hot one")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "made"))
    (made,) = (tmp_path / "made").glob("*.parquet")
    made.rename(tmp_path / "documents.parquet")
    got = queries.op13_cuckoo_dedup(spark, str(tmp_path))
    assert oracle.compare(got, oracle.connect(str(tmp_path)), queries.ORACLE["op13_cuckoo_dedup"]) is None
