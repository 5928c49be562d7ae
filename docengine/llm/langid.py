"""Language identification by unigrams over a fixed vocabulary, all segmentations summed.

The probability of a word in a language is the sum over all ways to cut it into
vocabulary pieces of the product of the pieces' probabilities in that language; a
forward pass over the word adds them up. A text's words are independent. Piece
probabilities come from expectation maximisation over the same segmentations.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import strings, worker_state, written

LETTERS = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")  # words: letters with their marks
START = "▁"  # the vocabulary's sign for the start of a word
BATCHED = 30  # words of up to so many letters are scored side by side, longer ones one by one
TAUGHT = 60  # longer words are scored, but piece probabilities are not learned from them
ROUNDS = 2
SMOOTHING = 0.05
UNKNOWN = 1e-8  # probability of a character that no piece holds
KNOWN_WORDS = 400_000  # distinct words that a task holds at a time
FIT_DIGITS = 3  # places of fits of which quantiles are taken
UNDETERMINED = "und"


class Vocabulary:
    """Pieces of a tokenizer file that can occur in lower-cased words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
        fits = lambda p: p == p.lower() and LETTERS.fullmatch(p.removeprefix(START) or "a")
        self.ids = {p: i for i, p in enumerate(sorted({p for p in pieces if fits(p)}))}
        self.size = len(self.ids)
        self.beginnings = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self._tree()

    def _tree(self) -> None:
        """The beginnings as numbered arrays, the ones that others continue first: ``first`` of
        a code point, ``after`` a beginning and a character by its column (0: none), ``piece``
        that a beginning is (-1: none). Characters that only begin pieces have column 0."""
        inner = {p[:-1] for p in self.beginnings if len(p) > 1}
        place = {p: i for i, p in enumerate([*sorted(inner), *sorted(self.beginnings - inner)], 1)}
        self.inner = len(inner)
        later = sorted({p[-1] for p in self.beginnings if len(p) > 1})
        self.first, self.column = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
        self.column[[ord(c) for c in later]] = np.arange(1, len(later) + 1)
        self.after = np.zeros((self.inner + 1, len(later) + 1), np.int32)
        self.piece = np.full(len(place) + 1, -1, np.int32)
        for p, i in place.items():
            if len(p) == 1:
                self.first[ord(p)] = i
            else:
                self.after[place[p[:-1]], self.column[ord(p[-1])]] = i
            self.piece[i] = self.ids.get(p, -1)

    def edges_from(self, word: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of the pieces that begin at a place of ``word`` (with its sign)."""
        if word[start] not in self.ids:
            yield start + 1, self.size
        end = start + 1
        while end <= len(word) and (part := word[start:end]) in self.beginnings:
            if part in self.ids:
                yield end, self.ids[part]
            end += 1

    def long_word(self, word: str, weight: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of one word of any length, per language.

        Prefix sums are kept for as many places as the longest piece reaches, and scaled
        down place by place, so that they neither vanish nor need the whole word. An upper
        bound of the memory is the longest piece, of the work the word times it.
        """
        word = START + word
        ahead: dict[int, np.ndarray] = {0: np.ones(weight.shape[1])}
        scale = np.zeros(weight.shape[1])
        for start in range(len(word)):
            here = ahead.pop(start)
            # A place is reached by single characters at least, so ``here`` is never 0.
            scale += np.log(here)
            for at in ahead:
                ahead[at] = ahead[at] / here
            for end, piece in self.edges_from(word, start):
                ahead[end] = ahead.get(end, 0.0) + weight[piece]
        return scale + np.log(ahead[len(word)])

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(word, start, end, piece) of every piece in every word, and for characters
        without a piece of their own the unknown one (``size``)."""
        lengths = np.array([len(word) + 1 for word in words], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text = "".join(chain.from_iterable((START, word) for word in words))
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        # No piece goes on with the sign that the next word begins with; 0 ends the last one.
        columns = np.append(self.column[codes], 0)
        at = np.arange(len(owner))
        state = self.first[codes]
        single = self.piece[state]
        places, ends, pieces = [at], [within + 1], [np.where(single < 0, self.size, single)]
        n = 1
        while True:
            on = np.flatnonzero((state > 0) & (state <= self.inner))
            at = at[on]
            state = self.after[state[on], columns[at + n]]
            n += 1
            known = np.flatnonzero(self.piece[state] >= 0)
            if not len(at):
                break
            places.append(at[known])
            ends.append(within[at[known]] + n)
            pieces.append(self.piece[state[known]])
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        place = place[order]
        return owner[place], within[place], np.concatenate(ends)[order], np.concatenate(pieces)[order].astype(np.int64)


def vocabulary(path: str) -> Vocabulary:
    kept = worker_state("vocabularies").setdefault("vocabularies", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def _by(place: np.ndarray, most: int) -> list[np.ndarray]:
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(most + 2))
    return [order[cuts[i] : cuts[i + 1]] for i in range(most + 1)]


def forward(words: list[str], edges: tuple, weight: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of every prefix; ``weight`` has the edges'
    probabilities, in one column per language."""
    w, start, end, _ = edges
    longest = max(map(len, words))
    total = np.zeros((len(words), longest + 2, weight.shape[1]))
    total[:, 0] = 1
    for i, own in enumerate(_by(end, longest + 1)):
        if len(own):
            np.add.at(total[:, i], w[own], total[w[own], start[own]] * weight[own])
    return total


def backward(words: list[str], edges: tuple, weight: np.ndarray) -> np.ndarray:
    w, start, end, _ = edges
    longest = max(map(len, words))
    total = np.zeros((len(words), longest + 2, weight.shape[1]))
    total[np.arange(len(words)), [len(word) + 1 for word in words]] = 1
    for i, own in reversed(list(enumerate(_by(start, longest + 1)))):
        if len(own):
            np.add.at(total[:, i], w[own], total[w[own], end[own]] * weight[own])
    return total


def words_of(text: str) -> list[str]:
    """Words of letters, lower-cased. A sign that is no letter (numbers among them) ends one."""
    return LETTERS.findall(text.lower())


def learn(documents: DataFrame, may_learn: Column, vocabulary_path: str) -> dict:
    """Languages, their shares and piece probabilities (``languages x pieces``).

    Shares and probabilities come from all labelled documents. The driver holds one row of
    pieces per language.
    """
    spark = documents.sparkSession
    labelled = documents.filter(
        may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("text", "lang")
    shares = {
        row["lang"]: row["n"]
        for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    languages = sorted(shares)
    if not languages:
        return {"languages": [], "prior": np.zeros(0), "pieces": np.zeros((0, 0))}
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for batch in batches:
            for text, lang in zip(strings(batch.column("text")), batch.column("lang").to_pylist()):
                seen.setdefault(number[lang], Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > KNOWN_WORDS:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    def rows(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            words = {word: n for word, n in words.items() if len(word) <= TAUGHT}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.int32()),
                    pa.array(list(words), pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )

    words = written(
        labelled.mapInArrow(count, "lang int, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n")),
        "words",
        of_texts=True,
    )
    size = vocabulary(vocabulary_path).size
    pieces = np.full((len(languages), size + 1), 1.0 / size)
    for _ in range(ROUNDS):
        pieces = _round(words, pieces, vocabulary_path)
    total = sum(shares.values())
    return {
        "languages": languages,
        "prior": np.log([shares[lang] / total for lang in languages]),
        "pieces": pieces,
    }


def least_fit(documents: DataFrame, model: dict, vocabulary_path: str) -> float:
    """A bound on ``fit`` below which a text is in none of the learned languages, from all
    labelled documents; see ``fit_bound``."""
    if not model["languages"]:
        return float("-inf")
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit_bound(predict(labelled.select("text", "lang"), model, vocabulary_path, fit=True), "lang")


def fit_bound(found: DataFrame, lang: str | Column) -> float:
    """The bound on ``fit`` from rows of ``predict`` and their labels (null: not labelled).

    Of each language the median, less three times its distance to the lowest hundredth; the
    lowest of these. Quantiles are exact, of fits rounded to thousandths, which are counted
    first. Minus infinity where there is no labelled row.
    """
    lang = F.col(lang) if isinstance(lang, str) else lang
    counted = (
        found.select(lang.alias("lang"), F.round("fit", FIT_DIGITS).alias("fit"))
        .filter("lang IS NOT NULL AND fit IS NOT NULL")
        .groupBy("lang", "fit")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = F.percentile("fit", F.array(F.lit(0.01), F.lit(0.5)), F.col("n"))
    rows = counted.groupBy("lang").agg(at.alias("at")).collect()
    return min((row["at"][1] - 3 * (row["at"][1] - row["at"][0]) for row in rows), default=float("-inf"))


def _round(words: DataFrame, pieces: np.ndarray, path: str) -> np.ndarray:
    """One step of expectation maximisation: expected numbers of pieces, normalised."""
    given = pieces.copy()
    given[:, -1] = UNKNOWN
    current = words.sparkSession.sparkContext.broadcast(given)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(path)
        p = current.value
        sums = np.zeros_like(p)
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                own = rows.column("word").to_pylist()
                lang = rows.column("lang").to_numpy()
                times = rows.column("n").to_numpy()
                edges = found.lattice(own)
                w, start, end, piece = edges
                weight = p[lang[w], piece][:, None]
                ahead, behind = forward(own, edges, weight), backward(own, edges, weight)
                whole = behind[:, 0, 0]
                used = ahead[w, start, 0] * weight[:, 0] * behind[w, end, 0] / whole[w] * times[w]
                np.add.at(sums, (lang[w], piece), used)
        lang, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(lang, pa.int32()),
                pa.array(piece, pa.int32()),
                pa.array(sums[lang, piece], pa.float64()),
            ],
            names=["lang", "piece", "n"],
        )

    rows = (
        words.mapInArrow(expect, "lang int, piece int, n double")
        .groupBy("lang", "piece")
        .agg(F.sum(F.round("n", 6).cast("decimal(30,6)")).cast("double").alias("n"))
        .toPandas()
    )
    sums = np.zeros_like(given)
    sums[rows["lang"].to_numpy(int), rows["piece"].to_numpy(int)] = rows["n"].to_numpy()
    sums = sums[:, :-1] + SMOOTHING
    made = np.full_like(given, UNKNOWN)
    made[:, :-1] = sums / sums.sum(axis=1, keepdims=True)
    return made


def predict(
    documents: DataFrame, model: dict, vocabulary_path: str, fit: bool = False
) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its posterior) to the rows, all columns kept; with
    ``fit`` also ``fit``, the mean log probability of a letter in that language, which says
    whether the text looks like the language at all (null for ``und``), and ``letters``.

    Every word of a text counts, and all segmentations of a word, however long it is. ``und`` with score 0 for null texts, texts without a
    letter, and where no language was learned. Equal posteriors go to the language
    that comes first. Columns of these names are replaced.
    """
    spark = documents.sparkSession
    columns = ["lang_pred", "score"] + ["fit", "letters"] * fit
    rows = documents.drop(*columns)
    shared = spark.sparkContext.broadcast(model)
    kinds = [F.lit("").cast("string"), *[F.lit(None).cast("double")] * (len(columns) - 1)]
    schema = rows.select("*", *[kind.alias(name) for kind, name in zip(kinds, columns)]).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(vocabulary_path)
        languages, prior = shared.value["languages"], shared.value["prior"]
        pieces = shared.value["pieces"].T
        seen = _Words(found, pieces)
        for batch in batches:
            if len(seen.known) > KNOWN_WORDS:
                seen = _Words(found, pieces)
            names, values, fits, letters = [], [], [], []
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 1000):
                words = [
                    words_of(text) if languages else []
                    for text in strings(texts.slice(at, 1000))
                ]
                seen.add(words)
                for own in words:
                    if not own:
                        names.append(UNDETERMINED)
                        values.append(0.0)
                        fits.append(None)
                        letters.append(0.0)
                        continue
                    said = seen.of(own).sum(axis=0)
                    total = said + prior
                    best = int(total.argmax())
                    names.append(languages[best])
                    values.append(float(1.0 / np.exp(total - total[best]).sum()))
                    letters.append(float(sum(map(len, own))))
                    fits.append(float(said[best]) / letters[-1])
            made = [pa.array(names, pa.string()), pa.array(values, pa.float64())]
            if fit:
                made += [pa.array(fits, pa.float64()), pa.array(letters, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], names=[*batch.schema.names, *columns]
            )

    return rows.mapInArrow(score, schema)


class _Words:
    """Log probabilities of words per language, in a table that grows by doubling."""

    def __init__(self, found: Vocabulary, pieces: np.ndarray):
        self.found, self.pieces = found, pieces
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, pieces.shape[1]))

    def add(self, words: list[list[str]]) -> None:
        new = sorted(set(chain.from_iterable(words)).difference(self.known), key=len)
        first, n = len(self.known), len(self.known) + len(new)
        if n > len(self.table):
            larger = np.zeros((max(n, 2 * len(self.table)), self.table.shape[1]))
            larger[:first] = self.table[:first]
            self.table = larger
        short = bisect_right(new, BATCHED, key=len)
        for at in range(0, short, 4000):
            part = new[at : min(short, at + 4000)]
            edges = self.found.lattice(part)
            total = forward(part, edges, self.pieces[edges[3]])
            last = total[np.arange(len(part)), [len(word) + 1 for word in part]]
            self.table[first + at : first + at + len(part)] = np.log(last)
        for i in range(short, len(new)):
            self.table[first + i] = self.found.long_word(new[i], self.pieces)
        self.known.update(zip(new, range(first, n)))

    def of(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from; a null id is not held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(False))
