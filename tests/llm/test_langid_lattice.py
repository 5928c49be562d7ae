"""The pieces in words, found for all words at once, against a walk over each word."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from docengine.llm import langid  # noqa: E402


def test_lattice_agrees_with_a_walk_over_each_word(monkeypatch):
    found = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["haus", "grün", "a", "internationale", "zzzxq", "中文", "𐐨𐐩", "ж" * 70, "été", "ﬁn", "a"]
    for some in (words, words[::-1], ["中"], []):
        walked = [
            (w, start, end, piece)
            for w, word in enumerate(some)
            for start in range(len(word) + 1)
            for end, piece in found.edges_from(langid.START + word, start)
        ]
        with monkeypatch.context() as patch:
            patch.setattr(langid.Vocabulary, "edges_from", None)  # no walk in Python
            assert list(zip(*(part.tolist() for part in found.lattice(some)))) == walked
