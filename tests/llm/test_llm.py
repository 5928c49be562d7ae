"""Operators of the training-data package against brute force, and their edge cases."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("docengine.llm")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import oracle  # noqa: E402
from docengine.llm import queries, token_codec, warc  # noqa: E402
from docengine.llm.embedding_dedup import (  # noqa: E402
    chosen_cells, fit_centres, likely_pairs, linked_vectors,
)
from docengine.llm.graph import components  # noqa: E402
from docengine.llm.langid import held_out, learn, predict  # noqa: E402
from docengine.llm.mixing import mix, mixed, share_out, split_quotas  # noqa: E402
from docengine.llm.ngram_join import (  # noqa: E402
    choose_bands, gram_set, linked_documents, without_near_duplicates,
)
from docengine.llm.packing import (  # noqa: E402
    carried,
    least_sequences,
    pack,
    place_best_fit,
    sequences,
    sweep,
    sweeps,
)
from docengine.llm.secret_scan import find_spans, new_ledger, redacted, scan_history, spelled  # noqa: E402
from docengine.llm.token_counts import empty_cache, token_counts  # noqa: E402
from docengine.llm.token_output import read_token_files, segment, segments, write_token_files  # noqa: E402
from docengine.llm.tokenization import Encoder  # noqa: E402
from docengine.llm.topk import Best, build_tree, search_tree, top_k  # noqa: E402

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, digest int"

LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
EDGE = [
    (1, None, "en", "a", 0, "s", 1),
    (2, "", "en", None, 0, None, None),
    (3, " \n\t", None, "a", 3, "s", 1),
    (4, "one two", "en", "b", 7, "s", 1),
    (4, "one two", "en", "b", 7, "s", 1),
    (5, "one two", "fr", "b", 7, "s", 1),
    (None, "one two three four five six seven", None, None, None, None, None),
    (6, "one two three four five six seven", "en", "a", 33, "s", 1),
    (7, LONG, "en", "c", len(LONG), "s", 1),
    (8, "<|endoftext|> secret = abcdef123 \U0001f600 \xa0\n\nx", "en", "c", 20, "s", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_level_ids_are_the_librarys():
    rng = random.Random(1)
    letters = list("abÀé ß\n\t .,'\"1２ａ́İΣς中\U0001f600\xa0\x85 -_|<>") + ["<|endoftext|>", "'s", "'ll", "  ", "\n\n"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(1500)]
    for path in (BYTES, WORDS):
        own, library = Encoder(path), Tokenizer.from_file(path)
        for text in texts:
            assert own.ids(text) == raw(library.encode(text, add_special_tokens=False).ids), text


def test_token_counts(spark, edge, nothing):
    cache = empty_cache(spark)
    for _ in range(2):
        got = token_counts(edge, BYTES, cache, limit=5).collect()
        expected = [(r[0], len((r[1] or "").encode()), len(ids_of(BYTES, r[1]))) for r in EDGE]
        assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(expected, key=str)
        assert all(r["over_limit"] == (r["n_tokens"] > 5) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in EDGE})  # the second run adds nothing
    assert token_counts(nothing, BYTES, cache).count() == 0


def test_codec_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 2047, 2048, 2049, 9000):
        for high in (2, 300, 70_000, 1 << 30):
            ids = rng.integers(0, high, n).astype("<u4")
            assert (token_codec.decode_blocks(token_codec.encode_blocks(ids)) == ids).all()
    again = np.tile(np.arange(50, dtype="<u4"), 400)
    assert sum(len(b) for _, _, b in token_codec.encode_blocks(again)) < 4 * len(again) / 20
    with pytest.raises(ValueError):
        token_codec.encode_blocks(np.array([1 << 31], "<u4"))


def test_damage_is_found():
    made = segment(3, 1, [(7, 4), (None, 2)], raw([1, 2, 3, 4, 5, 6])) + b"\n"
    ((file, number, directory, ids),) = segments(made)
    assert (file, number, directory["ids"].tolist(), ids.tolist()) == (3, 1, [4, 2], [1, 2, 3, 4, 5, 6])
    for at in (0, 20, len(made) // 2, len(made) - 4):
        broken = bytearray(made)
        broken[at] ^= 0x55
        with pytest.raises(Exception):
            list(segments(bytes(broken)))
    with pytest.raises(ValueError):
        list(segments(made[:-3]))


def test_token_files(spark, edge, nothing, tmp_path):
    write_token_files(edge, BYTES, 2, str(tmp_path / "a"))
    got = read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and zlib.crc32(r["ids"]) == r["ids_crc32"]
        start += r["n_tokens"]
    expected = [(r[0], raw([*ids_of(BYTES, r[1]), 2])) for r in EDGE]
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=str) == sorted(expected, key=str)
    write_token_files(nothing, BYTES, 2, str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def best_fit_decreasing(lengths, capacity):
    """Sequences that serial best fit opens."""
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        room = gaps.pop(at) if at < len(gaps) else capacity
        opened += at == len(gaps) and room == capacity
        if room > length:
            insort(gaps, room - length)
    return opened


def test_sweeps_take_the_successor():
    """A gap takes the longest document that fits and no smaller gap took, until none fits."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        capacity = int(rng.choice([5, 10, 37, 100]))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 60))
        rooms = np.sort(rng.integers(1, capacity + 1, rng.integers(0, 40)))
        gap_of, offset, left = sweeps(lengths, rooms, capacity)
        assert (left >= 0).all()
        waiting = lengths[gap_of < 0]
        assert not len(waiting) or not len(left) or waiting.min() > left.max()
        for gap in range(len(rooms)):
            own = np.flatnonzero(gap_of == gap)
            own = own[np.argsort(offset[own])]
            ends = capacity - rooms[gap] + np.cumsum(lengths[own])
            assert (offset[own] == ends - lengths[own]).all()
            assert left[gap] == rooms[gap] - lengths[own].sum()
    docs, gaps = np.array([3, 4, 7, 9]), np.array([5, 8, 8])
    taken, taker, _ = sweep(docs, gaps)
    assert sorted(zip(docs[taken], gaps[taker])) == [(3, 8), (4, 5), (7, 8)]


def test_no_packing_has_fewer_sequences_than_the_bound():
    for lengths, capacity, least in [
        ([6, 6, 6], 10, 3), ([4, 4, 4, 4, 4], 10, 3), ([10], 10, 1), ([7, 7, 3, 3], 10, 2),
        ([7, 7, 4, 4], 10, 3), ([1] * 11, 10, 2), ([5, 5, 5], 10, 2), ([6, 3, 3, 3], 10, 2),
    ]:
        assert least_sequences(Counter(lengths), capacity) == least
        assert best_fit_decreasing(lengths, capacity) >= least


def test_places_carried_between_ranges():
    runs = carried([(0, 0, 5), (1, 2, 3), (2, 4, 0), (4, 9, 1)])
    assert runs == [(0, 0, 2, 1, 0), (1, 0, 3, 2, 0), (0, 2, 1, 2, 3), (0, 3, 2, 4, 0)]


@pytest.mark.parametrize("range_rows", [10_000, 200])
def test_supersteps_pack_as_best_fit(spark, range_rows):
    """Gapless, whole, and no more sequences than one in a hundred above serial best fit; a third
    of the documents has one length."""
    rng = np.random.default_rng(5)
    lengths = np.concatenate([np.full(500, 70), rng.integers(1, 301, 500), rng.integers(1, 40, 500)])
    frame = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, size long")
    rows = place_best_fit(frame, 300, range_rows).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(lengths)))
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence"], []).append((r["offset"], int(lengths[r["id"]])))
    for places in inside.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 300
    assert len(inside) <= 1.01 * best_fit_decreasing(lengths.tolist(), 300)


def test_packing(edge, nothing):
    packed = pack(edge, WORDS, 1, 64, with_ids=True)
    rows = packed.collect()
    whole = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["start"] == r["piece"] * 64 and 1 <= r["length"] <= 64
    one = sorted((r for r in rows if r["doc_id"] == 7), key=lambda r: r["piece"])
    assert b"".join(bytes(r["ids"]) for r in one) == raw([*ids_of(WORDS, LONG), 1])
    for r in sequences(packed).collect():
        whole[r["sequence_id"]] = r
        assert r["length"] == len(r["ids"]) // 4 <= 64
    for r in rows:
        own = whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert bytes(own) == bytes(r["ids"])
    assert pack(nothing, WORDS).count() == 0


def brute_links(docs):
    sets = [set(gram_set(t or "").tolist()) for _, t in docs]
    alike = lambda x, y: x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9
    return [[j for j in range(len(docs)) if j != i and alike(sets[i], sets[j])] for i in range(len(docs))]


def test_ngram_join(spark, nothing):
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(6)]
    docs = [(None, base[0])]
    for text in base:
        for _ in range(rng.randint(1, 12)):
            words = text.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(60)] = rng.choice("klm")
            docs.append((len(docs), " ".join(words)))
    docs += [(100, None), (101, ""), (102, "Short text"), (103, "short  TEXT"), (103, "short  TEXT")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    links = brute_links(docs)
    got = linked_documents(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted(
        (str(docs[i][0]), len(links[i])) for i in range(len(docs))
    )
    seen, groups = set(), []
    for i in range(len(docs)):
        if i not in seen:
            group, todo = set(), [i]
            while todo:
                j = todo.pop()
                if j not in group:
                    group.add(j)
                    todo += links[j]
            seen |= group
            groups.append({docs[j][0] for j in group})
    least = {str(i): min((x for x in g if x is not None), default=None) for g in groups for i in g}
    assert all(r["component_id"] == least[str(r["doc_id"])] for r in got)
    kept = without_near_duplicates(frame).collect()
    assert len(kept) == len(groups) and set(kept[0].asDict()) == {"doc_id", "text"}
    assert linked_documents(nothing).count() == 0 and without_near_duplicates(nothing).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.16 * rng.normal(size=16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16),
             (2004, [1.0, 2.0]), (2005, []), (2006, [1e200] * 16), (None, [5.0, 5.5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and v[0] is not None and np.isfinite(v).all() and any(v)]
    matrix = np.array([rows[i][1] for i in usable])
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    expected = {rows[i][0]: int(near[k].sum()) - 1 for k, i in enumerate(usable)}
    got = {r["vec_id"]: r for r in linked_vectors(frame).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in expected)
    assert 0.9 * sum(expected.values()) <= found <= sum(expected.values())
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert linked_vectors(frame.limit(0)).count() == 0


def unit_near(rng, base, cosine):
    """A vector of length one for each row of ``base``, at that cosine to it."""
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine**2) * away


def link_recall(spark, matrix, **options):
    """Links found of those that brute force finds; no vector may have more."""
    rows = [(i, v) for i, v in enumerate(matrix.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = (matrix @ matrix.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in linked_vectors(frame, **options).collect()}
    assert len(got) == len(rows) and all(got[i] <= near[i] for i in got)
    return sum(got.values()) / near.sum()


def test_dense_group_over_many_cells(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(4800, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[:1600] = unit_near(rng, np.tile(matrix[0], (1600, 1)), 0.965)
    rng.shuffle(matrix)
    assert link_recall(spark, matrix, cell_vectors=12) >= 0.999  # 400 centres


def test_links_over_borders_of_cells(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(4200, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix[1400:2800] = unit_near(rng, matrix[2800:], rng.uniform(0.9, 0.93, (1400, 1)))
    sparse = link_recall(spark, matrix, cell_vectors=35)  # 120 centres
    matrix[:1400] = unit_near(rng, np.tile(matrix[0], (1400, 1)), 0.965)
    rng.shuffle(matrix)
    assert sparse >= 0.99 and link_recall(spark, matrix, cell_vectors=35) >= 0.999


@pytest.mark.parametrize("common", [0.0, 1.0, 1.5])
def test_exact_way_finds_every_link(spark, common):
    """Also where all vectors share a direction; components are compared as well."""
    rng = np.random.default_rng(12)
    matrix = rng.normal(size=(900, 16)) + common * np.ones(16)
    matrix[600:] = matrix[:300] + 0.25 * rng.normal(size=(300, 16))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in linked_vectors(frame, probes=None, cell_vectors=20).collect()}
    near = matrix @ matrix.T >= 0.9
    assert [got[i]["n_links"] for i in range(900)] == (near.sum(axis=1) - 1).tolist()
    smallest = list(range(900))
    for _ in range(60):
        smallest = [min(smallest[j] for j in np.flatnonzero(row)) for row in near]
    assert [got[i]["component_id"] for i in range(900)] == smallest
    assert [got[i]["kept"] for i in range(900)] == [smallest[i] == i for i in range(900)]


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_cells_where_vectors_share_a_direction(spark, common):
    """``common``: the mean cosine of pairs. Components are those of links that were found."""
    rng = np.random.default_rng(21)
    matrix = rng.normal(size=(6000, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    within = (0.9 - common) / (1 - common)
    matrix[3000:] = unit_near(rng, matrix[:3000], rng.uniform(within, 1, (3000, 1)))
    towards = rng.normal(size=64)
    towards /= np.linalg.norm(towards)
    matrix = np.sqrt(common) * towards + np.sqrt(1 - common) * matrix
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    near = matrix @ matrix.T >= 0.9
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in linked_vectors(frame, cell_vectors=60).collect()}  # 100 centres
    assert len(got) == 6000 and all(got[i]["n_links"] <= near[i].sum() - 1 for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * (near.sum() - 6000)
    smallest = np.arange(6000)
    for _ in range(40):
        smallest = np.array([smallest[row].min() for row in near])
    same = [got[i]["component_id"] == smallest[i] for i in range(6000)]
    assert np.mean(same) >= 0.98 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("common", [0.0, 0.5, 0.7])
def test_cells_are_no_chains(common):
    """Many centres stay many cells, unless fewer compare less for the recall."""
    rng = np.random.default_rng(4)
    matrix = np.sqrt(common) * np.eye(1, 64) + np.sqrt((1 - common) / 64) * rng.normal(size=(8000, 64))
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    centres, starts, probes, reach = chosen_cells(matrix, fit_centres(matrix, 200), 100_000, 0.9)
    assert len(centres) == 200 and (len(starts) >= 100 or common == 0.7)
    a, b, real = likely_pairs(matrix, 0.9, seed=5)
    made = (a * b).sum(axis=1)[~real]
    assert np.allclose(made, 0.9) and np.isclose((b * b).sum(axis=1), 1).all()
    cells = []
    for side in (a, b):
        near = np.maximum.reduceat(side @ centres.T, starts, axis=1)
        best = np.argsort(-near, axis=1)[:, :probes]
        value = np.take_along_axis(near, best, axis=1)
        cells.append([set(row[v >= v[0] - reach]) for row, v in zip(best, value)])
    assert np.mean([bool(x & y) for x, y in zip(*cells)]) >= 0.985


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 10.0 ** (i % 7)).tolist()) for i in range(140)]
    rows += [(200, [1e6] * 64), (201, [1e6] * 63 + [-9e5]), (202, [0.5] * 64), (203, [float("inf")] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if np.isfinite(v).all()}
    expected = []
    for q, v in whole.items():
        scores = [
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v)
        ]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:5], 1)]
    assert sorted(tuple(r) for r in top_k(frame, F.lit(True)).collect()) == sorted(expected)
    assert max(s for *_, s in expected) > 1 << 61
    with pytest.raises(Exception, match="no 64-bit integer"):
        top_k(spark.createDataFrame([(1, [1e8]), (2, [1e8])], frame.schema), F.lit(True)).collect()


def test_search_beyond_64_bits():
    rng = np.random.default_rng(2)
    points = rng.integers(-(1 << 60), 1 << 60, size=(300, 3))
    points[::3] //= 1 << 45
    asked = np.array([[1 << 60, 5, -7], [3, -(1 << 40), 1], [1, 2, 3]])
    best = [Best(4) for _ in asked]
    search_tree(build_tree(points, np.arange(300), np.ones(300, np.int64)), asked, np.array([-1] * 3), best)
    for query, found in zip(asked.tolist(), best):
        scores = sorted((sum(a * b for a, b in zip(query, p)), -i) for i, p in enumerate(points.tolist()))
        assert sorted(found.heap) == scores[-4:]


def test_language(spark, nothing):
    rng = random.Random(4)
    words = {"en": ["the", "house", "green", "with"], "de": ["das", "haus", "grün", "mit"], "fr": ["la", "maison", "verte", "avec"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "12 !?", "de"), (1002, "x" * 100_000 + " das haus grün mit", None), (None, "la maison", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", held_out(F.col("doc_id")))
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = learn(frame, ~F.col("held_out"), pieces)
    got = {r["doc_id"]: r for r in predict(frame, model, pieces).collect()}
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    test = [r for r in got.values() if r["held_out"] and r["lang"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.98 * len(test)
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"] and got[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = learn(nothing, F.lit(True), pieces)
    assert {r["lang_pred"] for r in predict(frame, empty, pieces).collect()} == {"und"}
    assert predict(nothing, model, pieces).count() == 0


def test_every_segmentation_of_a_word_counts():
    from itertools import product

    from docengine.llm import langid

    found = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    weight = np.random.default_rng(3).random((found.size + 1, 2)) * 1e-3
    words = ["haus", "grün", "a", "internationale", "zzzxq", "中文"]
    edges = found.lattice(words)
    total = langid.forward(words, edges, weight[edges[3]])
    for i, word in enumerate(words):
        whole, expected = langid.START + word, np.zeros(2)
        for cuts in product([0, 1], repeat=len(word)):
            ends = [j + 1 for j, cut in enumerate(cuts) if cut] + [len(whole)]
            value, at = np.ones(2), 0
            for end in ends:
                piece = found.ids.get(whole[at:end], found.size if end == at + 1 else None)
                value, at = value * (weight[piece] if piece is not None else 0), end
            expected += value
        assert np.allclose(total[i, len(whole)], expected) and np.allclose(found.long_word(word, weight), np.log(expected))
    halves = found.long_word("haus" * 20, weight) - found.long_word("haus" * 10, weight)
    assert np.isfinite(found.long_word("ab" * 50_000, weight)).all() and (halves < 0).all()
    assert langid.words_of("½ ② Ⅷ x1Y é") == ["x", "y", "é"]


def test_texts_in_no_learned_language_go(spark, nothing):
    import corpus_pipeline
    from docengine.llm.langid import least_fit

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [(-1, "xqzv kkwj pfft zzxq bvnm " * 3), (-2, "hyvää päivää mitä kuuluu tänään kaikille ystäville"), (-3, "½ ② Ⅷ"), (-4, None)]
    more = spark.createDataFrame([(i, t, None, "s", 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(more), SMALL).collect()}
    assert kept == {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert least_fit(nothing, {"languages": []}, "") == float("-inf")


def test_every_labelled_document_teaches_and_bounds(spark):
    from docengine.llm.langid import fit_bound, least_fit, vocabulary

    many = [("the house", "en")] * 3000 + [("das haus", "de")] * 3000
    frame = lambda rows: spark.createDataFrame(rows, "text string, lang string").repartition(3)
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    whole = learn(frame(many + [("zebra", "en")]), F.lit(True), pieces)
    ids = vocabulary(pieces).ids
    without = learn(frame(many), F.lit(True), pieces)
    better = {p for p, i in ids.items() if whole["pieces"][1, i] > without["pieces"][1, i]}
    assert any(p.strip("▁") and p.strip("▁") in "zebra" for p in better)
    fits = spark.createDataFrame([("a", -i / 100) for i in range(1, 101)] + [(None, -9.0), ("b", None)], "lang string, fit double")
    assert fit_bound(fits, "lang") == pytest.approx(-0.505 - 3 * (0.9901 - 0.505))
    assert fit_bound(fits.filter("false"), "lang") == float("-inf")
    assert np.isfinite(least_fit(frame(many), without, pieces))


def test_archives_are_made_and_read_in_small_parts():
    import pyarrow as pa

    from docengine.llm.common import parts_of
    from docengine.llm.warc import archive_rows, frames

    batch = pa.RecordBatch.from_pydict({"html": ["x" * 1000] * 300 + [None] * 5})
    parts = list(parts_of([batch, batch.slice(0, 0)], 50_000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.nbytes for p in parts) < 60_000
    records = [b"record %d " % i * 300 for i in range(400)]
    assert list(frames(memoryview(b"\n".join([*archive_rows(iter(records)), b""])))) == records


def test_draws_beyond_the_librarys_limit(monkeypatch):
    from docengine.llm import mixing

    draws = [mixing._draw(np.random.default_rng([6, i]), 3 * 10**9, 2 * 10**9, 10**9) for i in range(300)]
    spread = (1e9 * 0.6 * 0.4 * 0.8) ** 0.5
    assert abs(np.mean(draws) - 6e8) < spread / 4 and 0.85 < np.std(draws) / spread < 1.15
    monkeypatch.setattr(mixing, "LIMIT", 0)
    own = np.bincount([mixing._draw(np.random.default_rng([5, i]), 30, 50, 20) for i in range(20_000)], minlength=21)
    library = np.bincount(np.random.default_rng(2).hypergeometric(30, 50, 20, 20_000), minlength=21)
    assert np.abs(own - library).max() < 250
    assert [mixing._draw(np.random.default_rng(0), g, b, t) for g, b, t in ((0, 5, 3), (5, 0, 3), (4, 4, 0), (2, 3, 5))] == [0, 3, 0, 2]


def test_targets_and_splits():
    assert share_out([10, 10, 100], [5, 2, 1]) == pytest.approx([30, 30, 60])
    assert share_out([0, 0], [5, 2]) == [0, 0]
    quotas, parts = np.array([1000, 3, 0, 77]), [split_quotas(np.array([1000, 3, 0, 77]), 13, s, 5) for s in range(13)]
    assert sum(many for _, many in parts).tolist() == quotas.tolist()
    for (first, many), (after, _) in zip(parts, parts[1:]):
        assert (first + many == after).all()
    assert {int(many.sum()) for _, many in parts} <= {83, 84}


def test_mixing(spark, edge, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))  # reruns agree
    by = {}
    for r in rows:
        assert r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"]
        own = by.setdefault(r["source"], [0, 0, r["target"]])
        own[0] += r["size"]
        own[1] += r["taken"]
    names = sorted(by)
    targets = share_out([by[n][0] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [by[n][2] for n in names] == pytest.approx(targets)
    assert sum(abs(b[1] - b[2]) for b in by.values()) < 0.03 * sum(b[2] for b in by.values())
    assert mix(edge).count() == len(EDGE) and mix(nothing).count() == 0


def test_mixed_rows_are_shuffled_in_their_shards(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "source", "text")
    drawn = [r for r in queries.QUERIES["op2_mixing"](spark, SMALL).collect()]
    expected = sorted(
        (shard, key, r["doc_id"]) for r in drawn for shard, key in zip(r["shards"], r["shuffle_keys"])
    )
    got = [(r["_shard"], r["_order"], r["doc_id"]) for r in mixed(rows).collect()]
    assert sorted(got) == expected and len(expected) == sum(len(r["shards"]) for r in drawn)
    for shard in {s for s, *_ in got}:
        own = [key for s, key, _ in got if s == shard]
        assert own == sorted(own)
    stage = corpus_pipeline.mixing(spark, docs, SMALL)
    assert stage.columns == docs.columns
    # One shard here: the stage's rows come in its order, not copy beside copy.
    assert len({s for s, *_ in got}) > 1 or [r["doc_id"] for r in stage.collect()] == [i for *_, i in expected]


def test_secrets(spark, edge, nothing):
    texts = {
        "token: token: abcdefgh": "", "PassWord='hunter22'": "assign:0:18",
        "\U0001f600 api_key=abcdef": "assign:2:16", "x" + "a" * 24 + "g": "hex:1:25",
        "AKIA" + "B" * 16: "access:0:20", "AKIA" + "B" * 15: "",
        "secret=" + "0" * 24: "assign:0:31,hex:7:31", "": "",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r[0]: r[1] for r in frame.select("text", spelled(find_spans(F.col("text")))).collect()}
    assert got == texts
    hidden = frame.select("text", redacted(F.col("text"), find_spans(F.col("text"))).alias("out"))
    out = {r["text"]: r["out"] for r in hidden.collect()}
    assert out["\U0001f600 api_key=abcdef"] == "\U0001f600 [SECRET]" and out["secret=" + "0" * 24] == "[SECRET]"
    ledger = new_ledger(spark)
    versions = edge.select("doc_id", F.col("text").alias("content"), F.lit(1).alias("blob"))
    for _ in range(2):
        found = scan_history(versions, ledger)
        assert found.count() == len(EDGE)
        assert [r["n_found"]["assign"] for r in found.filter("doc_id = 8").collect()] == [1]
    assert spark.read.parquet(ledger).count() == len({r[1] or "" for r in EDGE})
    assert scan_history(versions.limit(0), ledger).count() == 0


def test_private_keys_go_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA7" + "x" * 40 for _ in range(300))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    texts = {
        f"a {key} b {key} c": "a [SECRET] b [SECRET] c",
        f"cut -----BEGIN PRIVATE KEY-----\n{body}\nThe rest.": "cut [SECRET] rest.",
        "-----BEGIN PUBLIC KEY-----": "-----BEGIN PUBLIC KEY-----",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", redacted(F.col("text"), find_spans(F.col("text"))).alias("out")).collect()
    assert {r["text"]: r["out"] for r in got} == texts


def test_ledger_is_kept_by_rule(spark):
    from dataclasses import replace

    from docengine.llm.secret_scan import RULES

    versions = spark.createDataFrame([(1, "AKIA" + "B" * 16), (2, "abc")], "doc_id int, content string")
    ledger = new_ledger(spark)
    scan_history(versions, ledger).count()
    changed = tuple(replace(r, pattern="abc", group=0, least=1, hint="abc") if r.kind == "url" else r for r in RULES)
    found = {r["doc_id"]: spelled_list(r) for r in scan_history(versions, ledger, changed).collect()}
    assert found == {1: ["access"], 2: ["url"]}
    rules = [len(r["rules"]) for r in spark.read.parquet(ledger).collect()]
    assert sorted(rules) == [1, 1, len(RULES), len(RULES)]  # only the changed rule ran again
    again = {r["doc_id"]: spelled_list(r) for r in scan_history(versions, ledger).collect()}
    assert again == {1: ["access"], 2: []} and spark.read.parquet(ledger).count() == 4


def spelled_list(row):
    return [span["kind"] for span in row["spans"]]


@pytest.mark.parametrize("names", [("_id", "_key", "_gone", "_row", "_text_key"), ("_l_doc_id", "_k_doc_id", "_pass", "_shard", "row")])
def test_clashing_names(spark, names):
    rows = [(1, "one two three four five six", "a", *range(5)), (2, "one two three four five six", "a", *range(5)), (3, None, None, *range(5))]
    columns = ["doc_id long", "text string", "source string", *[f"{n} int" for n in names]]
    frame = spark.createDataFrame(rows, ", ".join(columns))
    kept = without_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted(tuple(r) for r in kept.collect()) == sorted([rows[0], rows[2]])
    drawn = mix(frame)
    assert {tuple(r[n] for n in names) for r in drawn.collect()} == {tuple(range(5))}
    assert {"_pass", "_shard", "_order", "doc_id"} <= set(mixed(frame).columns) and mixed(frame).count() >= 2


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", None), (4, "u", ""), (None, "n", "same"),
             (5, "http://e", "<p>é\r\n\r\n</p>"), (6, "l", "long " * 300_000), (1, "again", "same")]
    pages += [(100 + i, f"http://x/{i}", f"<html>{i}" + "body text " * 400) for i in range(80)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_archives(warc.choose_records(frame), folder)
    rows = warc.read_archives(spark, folder)
    got = warc.checked_revisits(rows).collect()
    assert len(got) == len(pages) and all(r["resolved"] for r in got)
    for r in got:
        html = next((h or "").encode() for i, _, h in pages if i == r["page_id"])
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == warc.payload_digest(html)
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == html
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[2] == ("revisit", 1) and kinds[4] == ("revisit", 3) and kinds[1] == kinds[None] == ("response", None)
    few = warc.choose_records(frame, min_bytes=100)
    assert few.filter("record_type = 'revisit'").count() == 0
    warc.write_archives(warc.choose_records(frame.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_long_url_and_pages_without_id(spark, tmp_path):
    url = "http://a/" + "x" * 100_000
    rows = [(1, url, "<p>one</p>"), (2, "http://b", "<p>one</p>" * 9), (3, url, "<p>one</p>" * 9)]
    rows += [(None, "http://c", f"<p>{i}</p>") for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    warc.write_archives(warc.choose_records(frame, min_bytes=20), folder)
    got = warc.checked_revisits(warc.read_archives(spark, folder)).collect()
    assert sorted((r["page_id"] or 0, r["url"]) for r in got) == sorted((i or 0, u) for i, u, _ in rows)
    assert all(r["resolved"] for r in got) and [r["refers_to"] for r in got if r["refers_to"]] == [2]


def test_warc_damage():
    records = [warc.record(i, "http://a", b"payload " * 200 + str(i).encode(), "response", None) for i in range(400)]
    archive = b"".join(part + b"\n" for part in warc.archive_rows(iter(records)))
    assert int.from_bytes(archive[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.frames(archive)) == records
    with pytest.raises(Exception):
        list(warc.frames(archive[: len(archive) // 2]))
    with pytest.raises(ValueError):
        warc.parse_record(records[0][:-1])
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"payload", b"Payload", 1))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    assert oracle.compare(frame, oracle.connect(SMALL), queries.ORACLE[name]) is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL)
        assert made.columns == columns, name
        before, docs = docs, spark.createDataFrame(made.collect(), made.schema)
        assert name == "mixing" or docs.count() <= before.count()
    packed = corpus_pipeline.packing(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
