"""Runs of periodic words against brute force, and their edge cases."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import pytest

pytest.importorskip("docengine.llm")
from docengine.llm import periodic_runs as module  # noqa: E402
from docengine.llm import queries  # noqa: E402
from docengine.llm.periodic_runs import collapse, find_runs, periodic_runs  # noqa: E402


def brute(words, least=6, power=4):
    """Runs by comparing words at every distance."""
    n, ends = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, power * q):
                ends.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in ends.items())


def some_words(rng):
    kinds, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, n // 4)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = b"x"
    return words


@pytest.mark.parametrize("least, power", [(6, 4), (1, 3), (9, 5)])
def test_runs_are_those_of_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(400):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        for words, runs in zip(texts, find_runs(texts, least, power)):
            assert runs == brute(words, least, power), words


def test_one_word_a_hundred_thousand_times():
    assert find_runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    nested = ([b"a"] * 8 + [b"b"]) * 5
    assert find_runs([nested])[0] == brute(nested)
    with pytest.raises(ValueError):
        find_runs([[b"a"]], least_power=2)


def test_collapse_keeps_first_periods():
    words = b"x a b a b a b a b y".split()
    assert collapse(words, find_runs([words])[0]) == b"x a b y".split()


def test_edge_rows(spark, monkeypatch):
    schema = "doc_id long, text string, runs string, c0 int, words string, n_words int"
    rows = [
        (1, None, "s", 1, "w", 0), (2, "", None, None, None, None), (2, "", None, None, None, None),
        (None, " \t\n", "s", 1, "w", 0), (3, "a b " * 4, "s", 1, "w", 0),
        (4, "é x " * 6, "s", 1, "w", 0), (5, "a " * 70_000, "s", 1, "w", 0),
    ]
    frame = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(module, "WORDS_AT_ONCE", 4)
    got = periodic_runs(frame)
    assert got.columns == ["doc_id", "c0", "words", "n_words", "runs", "collapsed"]
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()]
    assert found == [
        (1, 0, [], ""), (2, 0, [], ""), (2, 0, [], ""), (None, 0, [], ""), (3, 8, [(0, 8, 2)], "a b"),
        (4, 6, [(0, 6, 1)], "é x"), (5, 70_000, [(0, 70_000, 1)], "a"),
    ]
    assert periodic_runs(frame.limit(0)).count() == 0
    assert periodic_runs(frame.select("text")).columns == ["n_words", "runs", "collapsed"]


def test_query_equals_brute_force(spark, tmp_path):
    """The registered query, its planted periods among them, over random texts."""
    rng = random.Random(5)
    rows = [(i, b" ".join(some_words(rng)).decode()) for i in range(400)] + [(None, None), (400, " a b\fc ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if n and doc_id is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        spelled = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        body = b" ".join(w for i, w in enumerate(words) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        expected.append((doc_id, len(runs), *best, milli, sha256(spelled.encode()).hexdigest(), sha256(body).hexdigest()))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 50
