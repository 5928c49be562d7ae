"""Token ids of texts by a tokenizer file, one word at a time.

A tokenizer of the BPE kind never merges across the pieces its pre-tokenizer
makes. Texts are cut where such a boundary is certain, each distinct piece is
encoded once by the library and kept in a bounded cache. Anything the cuts are
not certain about (unusual white space, special strings, other tokenizers) is
encoded whole by the library. ``Encoder.ids_of_all`` does so for many texts at once:
cuts are found in their bytes, and each distinct piece is looked up once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from docengine.llm.common import worker_state

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# A word is one pre-token when it ends the text or one of these follows it.
AFTER_WORD = r"[ \n\t.,;:!?*#%$&|()<>{}=\"/-]"
PIECES = re.compile(
    rf" ?[{LATIN}]+(?={AFTER_WORD}|\Z)"  # a word of plain letters
    rf"|\n(?=[{LATIN}])"  # a line break between two words
    r"|[ \n\t]*[^ \n\t]+"  # white space and what follows it
    r"|[ \n\t]+"  # white space at the end
)
WORD = re.compile(rf" ?[{LATIN}]+\Z")
# White space other than blank, tab and line feed, and code points that some
# libraries take for white space.
UNUSUAL = re.compile(
    r"[\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
)
SPACE, AFTER, LETTER = 1, 2, 4  # what a byte is: white space, sign after a word, plain letter
BYTES = np.zeros(256, np.uint8)
BYTES[list(b" \n\t")] = SPACE
BYTES[list(b".,;:!?*#%$&|()<>{}=\"/-")] = AFTER
BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = LETTER
CACHED_PIECES = 1_000_000
CACHED_LENGTH = 64


def file_digest(path: str) -> str:
    """Names a tokenizer version: digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class _Cache(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.specials = [token["content"] for token in made["added_tokens"]]
        self.kind = _kind(made)
        self.tokenize = self.tokenizer.model.tokenize
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(i) for i in (0x20, *range(0xC0, 0x100))]
        # How the byte level spells a blank (U+0120) and the letters beyond ASCII of a word.
        self.spelled = {
            ord(c): "".join(part for part, _ in as_bytes.pre_tokenize_str(c)) for c in letters
        }
        self.cache = _Cache(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ascii = piece.isascii()
        if not (piece.removeprefix(" ").isalpha() if ascii else WORD.match(piece)):
            return self._whole(piece)
        word = piece.strip(" ").lower() if self.kind == "words" else piece
        mapped = word.replace(" ", "\u0120") if ascii else word.translate(self.spelled)
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _cut(self, text: str) -> bool:
        return not (
            self.kind is None or UNUSUAL.search(text) or any(s in text for s in self.specials)
        )

    def ids(self, text: str) -> bytes:
        if not self._cut(text):
            return self._whole(text)
        return b"".join(map(self.cache.__getitem__, PIECES.findall(text)))

    def ids_of_all(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        cut = [self._cut(text) for text in texts]
        raw = [text.encode() for text, so in zip(texts, cut) if so]
        ends = np.cumsum([0, *map(len, raw)])
        data = b"".join(raw)
        begins = _piece_begins(np.frombuffer(data, np.uint8), ends)
        offsets = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        own = [self.cache[piece] for piece in coded.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.array([len(ids) // 4 for ids in own], np.int64)
        known = np.frombuffer(b"".join(own), "<u4")
        size = sizes[code]
        stops = np.cumsum(size)
        moved = (np.cumsum(sizes) - sizes)[code] - (stops - size)
        ids = known[np.repeat(moved, size) + np.arange(int(size.sum()))]
        counts = np.diff(np.append(0, stops)[np.searchsorted(begins, ends)])
        if len(raw) == len(texts):
            return ids, counts
        parts = iter(np.split(ids, np.cumsum(counts)[:-1]))
        by_text = [
            next(parts) if so else np.frombuffer(self._whole(text), "<u4")
            for text, so in zip(texts, cut)
        ]
        return np.concatenate(by_text), np.array([len(own) for own in by_text], np.int64)


def _piece_begins(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that end at ``ends`` (first: 0). Pieces
    begin with each text, with white space after anything else, with a sign after a
    word of plain letters that white space or nothing precedes, and with a letter
    after a line break that begins a piece."""
    if not len(raw):
        return np.empty(0, np.int64)
    kind = BYTES[raw]
    latin = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF, of which two are no letters
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True  # also the end of all
    space, letter = kind == SPACE, kind == LETTER
    begins = first[:-1].copy()
    begins[1:] |= space[1:] & ~space[:-1]
    line = np.flatnonzero((raw[:-1] == 0x0A) & begins[:-1] & letter[1:]) + 1
    # Words: runs of letters within a text.
    starts = letter.copy()
    starts[1:] &= ~letter[:-1] | first[1:-1]
    starts = np.flatnonzero(starts)
    last = letter.copy()
    last[:-1] &= ~letter[1:] | first[1:-1]
    stops = np.flatnonzero(last) + 1
    stops = stops[first[starts] | space[starts - 1]]
    stops = stops[~first[stops]]
    begins[line] = True
    begins[stops[kind[stops] == AFTER]] = True
    return np.flatnonzero(begins)


def _kind(made: dict) -> str | None:
    """``bytes``: byte level with the usual word pattern, white space kept.
    ``words``: lower-cased words, white space dropped. None: anything else."""
    model, before, normal = made["model"], made["pre_tokenizer"] or {}, made["normalizer"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or made.get("post_processor") or made.get("truncation") or made.get("padding"):
        return None
    if before.get("type") == "ByteLevel" and normal is None:
        usual = before["use_regex"] and not before["add_prefix_space"]
        return "bytes" if usual and not model.get("end_of_word_suffix") else None
    if before.get("type") == "Sequence" and normal and normal.get("type") == "Sequence":
        steps = [step["type"] for step in before["pretokenizers"]]
        cleaned = [step["type"] for step in normal["normalizers"]]
        split = before["pretokenizers"][0]
        if (
            steps == ["Split", "ByteLevel"]
            and cleaned == ["NFC", "Replace", "Lowercase"]
            and split["invert"]
            and split["behavior"] == "Removed"
            and r"[\p{L}]+" in split["pattern"].get("Regex", "")
        ):
            return "words"
    return None


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept from task to task."""
    kept = worker_state("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
