"""The dual-tree search against brute force, its pruning, and its edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("docengine.llm")
from docengine.llm import lexical_search as module  # noqa: E402
from docengine.llm import queries  # noqa: E402
from docengine.llm.lexical_search import (  # noqa: E402
    TERM, Best, index_documents, order_by_halves, search, terms_of,
)

UPPER = {ord(c): c.lower() for c in module.UPPER}


def terms(text):
    return re.findall(TERM, (text or "").translate(UPPER))


def brute(items, documents, k):
    """Every score of the contract, from the definitions."""
    texts = [(d, Counter(terms(t))) for d, t in documents]
    texts = [(d, c) for d, c in texts if c]
    n, length = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, words in asked.items():
        scores = []
        for doc_id, counts in texts:
            m = 10 + (90 * sum(counts.values()) * n) // length
            score = 0
            for t in words & set(counts):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows, key=str)


def some_text(rng, words, most):
    return " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))


def corpus(seed, n):
    """Texts in three vocabularies, with copies, and items cut from some of them."""
    rng = random.Random(seed)
    words = [[f"{c}{i}" for i in range(80)] for c in "aBé"]
    documents = [(i, some_text(rng, rng.choice(words), 60)) for i in range(n)]
    documents += [(n + i, documents[i][1]) for i in range(n // 5)] + [(3, documents[4][1])]
    items = [(i, " ".join(documents[rng.randrange(n)][1].split()[:12])) for i in range(40)]
    return documents, items


def frames(spark, documents, items, parts=3):
    return (
        spark.createDataFrame(documents, "doc_id long, text string").repartition(parts),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_terms_of_bytes_are_those_of_the_pattern():
    rng = random.Random(0)
    letters = [chr(c) for c in range(256)] + list("中İſK\U0001f600")
    for _ in range(500):
        text = "".join(rng.choices(letters, k=30))
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("k", [1, 10, 500])
def test_search_is_brute_force(spark, k, monkeypatch):
    for name, value in (("SHARD_DOCUMENTS", 50), ("BATCH", 4), ("ITEMS_PER_BLOCK", 15), ("ITEM_BATCH", 3), ("FAN", 2), ("SHARDS_PER_GROUP", 2)):
        monkeypatch.setattr(module, name, value)
    documents, items = corpus(k, 300)
    docs, asked = frames(spark, documents, items)
    got = [tuple(r) for r in search(asked, index_documents(docs), k).collect()]
    assert sorted(got, key=str) == brute(items, documents, k)


def test_batches_are_pruned(monkeypatch):
    """Bounds spare most of the batches, and the order of halves keeps similar documents near."""
    rng = random.Random(4)
    documents = [(i, [b"%c%d" % (97 + i % 20, rng.randrange(30)) for _ in range(30)]) for i in range(1000)]
    rng.shuffle(documents)
    terms_part, postings = module.make_shard([d for d, _ in documents], [w for _, w in documents])
    asked = sorted(set(documents[0][1]))
    block = {"ids": [1], "terms": module.pa.array(asked, module.pa.binary()), "levels": [[np.arange(len(asked))]]}
    best, taken = [Best(5, 0)], []
    monkeypatch.setattr(Best, "take", lambda self, score, doc, put=Best.take: (taken.append(doc), put(self, score, doc)))
    module.search_shard(block, np.full(len(asked), 1000), best, terms_part, postings, 1000, 30_000)
    assert len(best[0].heap) == 5 and len(taken) < 100
    owner = np.arange(64) % 4
    order = order_by_halves(np.arange(64), owner, 64, 16)
    assert [len(set(owner[order[i : i + 16]].tolist())) for i in range(0, 64, 16)] == [1, 1, 1, 1]


def test_edge_rows(spark):
    schema = "doc_id long, text string, shard int, item_id string, terms int, part int"
    documents = [
        (None, "one two"), (None, "one two"), (1, None), (2, ""), (3, " \n\t-"), (4, "One TWO three"),
        (4, "One TWO three"), (5, "one " * 200_000), (6, "Éé one"), (7, "x" * 300_000),
    ]
    items = [(1, "one two"), (1, "THREE"), (2, None), (3, ""), (4, "absent"), (None, "two"), (5, "one"), (5, "one"), (6, "Éé")]
    docs = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in documents], schema)
    asked = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in items], "item_id long, text string, block int, doc_id string, weights int")
    got = [tuple(r) for r in search(asked, index_documents(docs), 3).collect()]
    assert sorted(got, key=str) == brute(items, documents, 3)
    assert search(asked.limit(0), index_documents(docs)).count() == 0
    assert search(asked, index_documents(docs.limit(0))).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    documents, items = corpus(7, 200)
    docs, asked = frames(spark, documents, items)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in queries.op11_dual_tree_search(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(items, documents, 10)


@pytest.mark.parametrize("broadcast", [True, False])
def test_shards_reach_python_a_few_at_a_time(spark, monkeypatch, broadcast):
    """A batch of many shards would be held at once, by the JVM and by the worker; few blocks
    come to the shards, which are not shuffled."""
    for name, value in (("SHARD_DOCUMENTS", 5), ("ITEMS_PER_BLOCK", 15), ("SHARDS_PER_GROUP", 8), ("PASS_BYTES", 32 << 20 if broadcast else 0)):
        monkeypatch.setattr(module, name, value, raising=False)
    plans, threshold = [], "spark.sql.autoBroadcastJoinThreshold"

    def checked(rows, label, *args, write=module.written, **options):
        if label == "other-shard-results":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, label, *args, **options)

    def searcher(*args, make=module._searcher):
        task = make(*args)

        def few(batches):
            for batch in batches:
                assert batch.num_rows <= 4
                yield batch

        return lambda batches: task(few(batches))

    monkeypatch.setattr(module, "written", checked)
    monkeypatch.setattr(module, "_searcher", searcher)
    documents, items = corpus(11, 200)
    docs, asked = frames(spark, documents, items, 2)
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = [tuple(r) for r in search(asked, index_documents(docs), 10).collect()]
    finally:
        spark.conf.set(threshold, before)
    assert sorted(got, key=str) == brute(items, documents, 10)
    assert broadcast == ("hashpartitioning(part" not in plans[0])
