"""Chunkers against plain Python, and their invariants, on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docengine.operators import chunking as ch

EDGES = ch.EDGES


def random_texts(n, seed):
    rng = random.Random(seed)

    def word():
        return "".join(rng.choices("abcé.😀", k=rng.choice([1, 2, 3, 5, 9, 60])))

    def text():
        return "".join(
            word() + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", "\n \n", "\n\n\n"])
            for _ in range(rng.randint(0, 60))
        )

    return [text() for _ in range(n)] + ["", "\n\n", " ", "\n\nabc", "abc\n", "x" * 200]


def run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return {r["i"]: r["r"] for r in rows.select("i", column.alias("r")).collect()}


def tiles_of(text, size):
    def body(t):
        return len(t.rstrip(EDGES))

    def cut(pieces, finer):
        return [x for p in pieces for x in ([p] if body(p) <= size else finer(p))]

    def words(line):
        found = re.findall(r"[^ ]* |[^ ]+\Z", line)
        return cut(found, lambda w: [w[i : i + size] for i in range(0, len(w), size)])

    def lines(par):
        return cut(re.findall(r"[^\n]*\n+\Z|[^\n]*\n|[^\n]+\Z", par), words)

    return cut(re.findall(r"(?s).*?\n\n|.+\Z", text), lines)


def recursive(text, size, overlap):
    spans, at = [], 0
    for tile in tiles_of(text, size):
        spans.append((at, at + len(tile.rstrip(EDGES))))
        at += len(tile)
    out, starts, end = [], [], 0
    for a, b in spans:
        if starts and b - starts[0] > size:
            out.append((starts[0], end))
            starts = [s for s in starts if end - s <= overlap and b - s <= size]
        starts.append(a)
        end = b
    if starts:
        out.append((starts[0], end))
    # a chunk's text runs to the end of its last tile's body
    return [c for c in (text[a:b].strip(EDGES) for a, b in out) if c]


@pytest.mark.parametrize("size, overlap", [(50, 20), (30, 0), (100, 99), (12, 4)])
def test_recursive(spark, size, overlap):
    texts = random_texts(150, seed=size)
    got = run(spark, texts, ch.recursive_chunks(F.col("text"), size, overlap))
    for i, text in enumerate(texts):
        chunks = got[i]
        assert [c["content"] for c in chunks] == recursive(text, size, overlap)
        assert [c["chunk_num"] for c in chunks] == list(range(len(chunks)))
        assert all(c["char_length"] == len(c["content"]) <= size for c in chunks)
        covered = "".join(c["content"] for c in chunks)
        assert set(re.sub(r"\s", "", text)) == set(re.sub(r"\s", "", covered))


def elements_of(text, limit, pattern):
    out = []
    for piece in re.split(pattern, text):
        rest = piece.strip(EDGES)
        while rest:
            if len(rest) <= limit:
                head, rest = rest, ""
            else:
                space = rest.rfind(" ", 0, limit + 1)
                cut = space if space > 0 else limit
                head, rest = rest[:cut], rest[cut + (space > 0) :]
            if head.strip(EDGES):
                out.append(head.strip(EDGES))
    return out


def packed(elements, limit, soft):
    out, current = [], None
    for element in elements:
        if current is None:
            current = element
        elif len(current) >= soft or len(current) + 2 + len(element) > limit:
            out.append(current)
            current = element
        else:
            current += "\n\n" + element
    return out + ([current] if current is not None else [])


@pytest.mark.parametrize("limit, soft", [(60, 40), (100, 10), (60, 60), (70, 1), (40, 90)])
@pytest.mark.parametrize("pattern", ["\n", r"\n\s*\n"])
def test_sequential(spark, limit, soft, pattern):
    texts = random_texts(120, seed=limit)
    got = run(spark, texts, ch.sequential_chunks(F.col("text"), limit, soft, pattern))
    for i, text in enumerate(texts):
        expected = packed(elements_of(text, limit, pattern), limit, min(soft, limit))
        assert [c["content"] for c in got[i]] == expected
        assert all(c["char_length"] == len(c["content"]) <= limit for c in got[i])
        assert all(c["category"] == "CompositeElement" for c in got[i])


def test_tables_stand_alone(spark):
    elements = [
        ("one", "Title", None), ("t", "Table", "<table>1</table>"), ("two", "Text", None),
        ("three", "Text", None), ("t", "Table", "<table>2</table>"), ("t", "Table", "<table>3</table>"),
        ("four", "Text", None),
    ]
    rows = spark.createDataFrame(
        [(elements,)], "e array<struct<text:string,kind:string,html:string>>"
    )
    chunks = rows.select(F.inline(ch.sequential_chunks_of(F.col("e"), 50, 30))).collect()
    assert [(c["content"], c["category"]) for c in chunks] == [
        ("one", "CompositeElement"), ("<table>1</table>", "Table"),
        ("two\n\nthree", "CompositeElement"), ("<table>2</table>", "Table"),
        ("<table>3</table>", "Table"), ("four", "CompositeElement"),
    ]


def combine(elements, limit):
    out, current = [], ""
    for element in elements:
        element = element.strip(EDGES)
        if len(current) + len(element) <= limit:
            current = f"{current} {element}"
        else:
            out.append(current.strip(EDGES))
            current = element
    return out + ([current.strip(EDGES)] if current else [])


def merge(chunks, limit):
    out, text, n = [], "", 0
    for chunk in chunks:
        if n + len(chunk) <= limit:
            text, n = f"{text} {chunk}", n + len(chunk)
        else:
            out.append((text, n))
            text, n = chunk, len(chunk)
    return out + ([(text, n)] if text else [])


@pytest.mark.parametrize("limit", [5, 30, 200])
def test_combine(spark, limit):
    texts = random_texts(100, seed=limit)
    lines = F.split("text", "\n")
    got = run(spark, texts, ch.combine_elements(lines, limit))
    assert got == {i: combine(t.split("\n"), limit) for i, t in enumerate(texts)}
    got = run(spark, texts, ch.combine_small_chunks(lines, limit))
    for i, text in enumerate(texts):
        assert [(c["content"], c["char_length"]) for c in got[i]] == merge(text.split("\n"), limit)


def test_folds_over_many_runs(spark):
    rng = random.Random(5)
    for n in (ch.RUN - 1, ch.RUN, ch.RUN + 1, 5 * ch.RUN + 3):
        text = "\n".join("w" * rng.randint(0, 30) + " v" for _ in range(n))
        lines = F.split("text", "\n")
        assert run(spark, [text], ch.combine_elements(lines, 100)) == {0: combine(text.split("\n"), 100)}
        got = run(spark, [text], ch.combine_small_chunks(lines, 100))[0]
        assert [(c["content"], c["char_length"]) for c in got] == merge(text.split("\n"), 100)
        got = run(spark, [text], ch.recursive_chunks(F.col("text"), 120, 40))[0]
        assert [c["content"] for c in got] == recursive(text, 120, 40)


def test_oversized_first_element_leaves_an_empty_group(spark):
    got = run(spark, ["abcdefgh"], ch.combine_elements(F.split("text", "\n"), 3))
    assert got == {0: ["", "abcdefgh"]}
    got = run(spark, ["abcdefgh"], ch.combine_small_chunks(F.split("text", "\n"), 3))
    assert [tuple(c) for c in got[0]] == [("", 0), ("abcdefgh", 8)]


def test_very_long_document(spark):
    """A book of a million characters in one row."""
    text = " ".join(f"w{i}" for i in range(150_000))
    got = run(spark, [text], ch.recursive_chunks(F.col("text")))
    assert [c["content"] for c in got[0]] == recursive(text, 1500, 500)
    got = run(spark, [text], ch.sequential_chunks(F.col("text")))
    assert [c["content"] for c in got[0]] == packed(elements_of(text, 1500, "\n"), 1500, 1000)


def test_documents_without_text_or_ok_status_give_no_chunks(spark):
    rows = spark.createDataFrame(
        [("a.pdf", "one two", "ok"), ("b.pdf", "", "ok"), ("c.pdf", None, "ok"),
         ("d.txt", "Unsupported file type: .txt", "unsupported")],
        "file_name string, text string, status string",
    )
    for chunks in (ch.recursive_chunks(F.col("text")), ch.sequential_chunks(F.col("text"))):
        assert [r["uuid"] for r in ch.chunk_documents(rows, chunks).collect()] == ["a.pdf_0"]
        every = ch.chunk_documents(rows, chunks, only_ok=False)
        assert sorted(r["uuid"] for r in every.collect()) == ["a.pdf_0", "d.txt_0"]


def test_suggested_chunks(spark):
    rows = spark.createDataFrame(
        [("d", "one two", "'[{\"chunk_number\": 1, \"content\": \"one\"}]'"),
         ("e", "one", '[{"chunk_number": 1, "content": "uno"}]'), ("f", "x", "no json"),
         ("g", "one", '{"chunk_number": 1, "content": "one"}'), ("h", "x", None)],
        "doc string, text string, response string",
    )
    got = sorted(tuple(r) for r in ch.suggested_chunks(rows).collect())
    assert got == [("d", 1, "one", True), ("e", 1, "uno", False)]
