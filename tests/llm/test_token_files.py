"""Token ids of many texts at once, and the coder's steps."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docengine.llm import token_codec, token_output
from docengine.llm.token_output import read_token_files, write_token_files
from docengine.llm.tokenization import Encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [
    *"abÀéÿ×÷ß\n\t .,'\"1２ａ́İΣς中\U0001f600 -_|<>", "'s", "'ll", "  ", "\n\n", " word", "\nword,",
]
RARE = ["\xa0", "\x85", "\r", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_all_are_the_librarys(name):
    path, rng = public_tokenizers.path(name), random.Random(7)
    own, library = Encoder(path), Tokenizer.from_file(path)
    for signs in (LETTERS, LETTERS + RARE):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)]
        expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
        ids, counts = own.ids_of_all(texts)
        assert counts.tolist() == [len(e) for e in expected]
        assert ids.tolist() == [i for e in expected for i in e]
    for texts in ([], [""], ["", "\xa0", ""], ["a", ""]):
        ids, counts = own.ids_of_all(texts)
        assert ids.tobytes() == b"".join(map(own.ids, texts)) and len(counts) == len(texts)


def test_a_piece_is_looked_up_once_for_all_texts():
    class Counting(dict):
        asked = 0

        def __getitem__(self, piece):
            self.asked += 1
            return own._piece(piece)

    own = Encoder(BYTES)
    own.cache = Counting()
    ids, counts = own.ids_of_all(["some words, some more words"] * 50)
    assert own.cache.asked == len({"some", " words", ",", " some", " more"})
    assert ids.tobytes() == 50 * Encoder(BYTES).ids("some words, some more words")


@pytest.mark.parametrize("n", [1, 63, 65, 2048, 2049, 3 * 2048 + 70])
def test_blocks_of_all_sizes_of_ids(n):
    rng = np.random.default_rng(n)
    kinds = [
        rng.zipf(1.3, n) % 50_257, rng.integers(0, 256, n), rng.integers(0, 1 << 30, n),
        np.where(rng.random(n) < 0.5, 65_535, 65_536), np.full(n, (1 << 30) - 1), np.zeros(n),
        np.arange(n) % 7,
    ]
    for kind in kinds:
        ids = kind.astype("<u4")
        blocks = token_codec.encode_blocks(ids)
        assert [size for size, _, _ in blocks] == [min(2048, n - i) for i in range(0, n, 2048)]
        assert (token_codec.decode_blocks(blocks) == ids).all()


def test_a_step_codes_one_id_of_all_blocks(monkeypatch):
    """One symbol a step; what follows it comes with it, unless ids are large."""
    calls = []
    for name in ("put", "put_plain"):
        whole = getattr(token_codec._Writer, name)
        monkeypatch.setattr(
            token_codec._Writer, name, lambda *a, n=name, f=whole: (calls.append(n), f(*a))[1]
        )
    ids = np.random.default_rng(0).integers(0, 50_257, 3 * 2048).astype("<u4")
    token_codec.encode_blocks(ids)
    assert calls == ["put"] * 2048


def test_segments_hold_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, f"document {i} says " + "word, " * (i % 40)) for i in range(300)]
    rows += [(None, None), (7, "again"), (400, "long " * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_file(BYTES)
    expected = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]
    found, written = [], []
    for folder, values in (("a", {}), ("b", {"SEGMENT_IDS": 100, "TEXT_BYTES": 200})):
        # Tasks carry their own copy of the package, so they see these values.
        with monkeypatch.context() as patch:
            for name, value in values.items():
                patch.setattr(token_output, name, value)
            write_token_files(frame, BYTES, 2, str(tmp_path / folder))
        parts = [path.read_bytes() for path in (tmp_path / folder).glob("part-*")]
        written.append(sum(len(list(token_output.segments(part))) for part in parts))
        got = read_token_files(spark, str(tmp_path / folder), with_ids=True).collect()
        found.append(sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got))
        ids = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
        assert sorted(ids, key=str) == sorted(expected, key=str)
    assert found[0] == found[1] and written[0] < 20 < written[1]
