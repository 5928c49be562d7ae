"""Runs of periodic words, found as maximal pairs of an LCP-interval tree.

A run of period q is a stretch u of words that repeats at distance q, so its first
``length - q`` words are a word string that occurs at the run's start and q words on: a
pair of occurrences that neither a word to the left nor one to the right extends. Such
maximal pairs are read off the tree of LCP intervals, bottom up: two occurrences meet
first in the node of their longest common prefix, from different children (nothing to
the right extends them), and count if the words to their left differ. With the distance
at most a third of the common prefix, every maximal pair is a run, whole as it stands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_POWER = 4
# Words that are sorted together; a longer text is sorted alone.
WORDS_AT_ONCE = 1 << 17

RUNS_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least_shared(least_length: int, least_power: int) -> int:
    """The shortest common prefix that a run of any period has with itself, one period on."""
    return min(max(least_length - p, (least_power - 1) * p) for p in range(1, least_length + 1))


def sorted_suffixes(symbols: np.ndarray, ends: np.ndarray, least: int) -> tuple:
    """Suffixes in order, and what neighbours share, where that is ``least`` symbols or more.

    ``symbols`` are numbers that no two texts share, ``ends`` has the end of its text for
    every place. Ranks by 1, 2, 4, ... symbols, each round for the suffixes that are not
    yet alone; a suffix that ends precedes those that go on. Returns ``(slots, order,
    shared)``: slots i whose suffix ``order[i]`` shares ``shared`` symbols with the next.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    slots = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
    levels = [rank.copy()]
    alone = first & np.append(first[1:], True)
    open_slots = slots[~alone]
    reach = 1
    while len(open_slots):
        places = order[open_slots]
        after = places + reach
        inside = after < ends[places]
        following = np.where(inside, rank[np.where(inside, after, n)].astype(np.int64), -1)
        key = rank[places].astype(np.int64) * (n + 2) + following + 1
        by_key = np.argsort(key, kind="stable")
        places, key = places[by_key], key[by_key]
        order[open_slots] = places
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        rank[places] = np.maximum.accumulate(np.where(first, open_slots, 0))
        levels.append(rank.copy())
        alone = first & np.append(first[1:], True)
        open_slots = open_slots[~alone]
        reach *= 2
    # Neighbours that share the largest power of two up to ``least`` go on to the exact count.
    start = min(least.bit_length() - 1, len(levels) - 1)
    ranks = levels[start][order]
    near = np.flatnonzero(ranks[1:] == ranks[:-1])
    a, b = order[near], order[near + 1]
    shared = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][np.minimum(a + shared, n)] == levels[level][np.minimum(b + shared, n)]
        shared[same] += 1 << level
    enough = shared >= least
    return near[enough], order, shared[enough]


def maximal_pairs(places: list, shared: list, classes: list, power: int, found: dict) -> None:
    """Walk the LCP-interval tree of one stretch of sorted suffixes, bottom up.

    ``shared[i]`` is what ``places[i]`` shares with the next (0 at the end), ``classes``
    has the left word of every place. A node's list holds its places in order; on joining
    a child, each place of the shorter list looks at its neighbours of the other list: of
    the places within a third of the common prefix, only they can be one period away.
    ``found`` gets the smallest distance for (start, end).
    """
    stack: list[tuple[int, list]] = []

    def join(one: list, other: list, depth: int) -> list:
        if len(one) < len(other):
            one, other = other, one
        reach = depth // (power - 1)
        n = len(one)
        for place in other:
            at = bisect_left(one, place)
            own = classes[place]
            if at:
                before = one[at - 1]
                if place - before <= reach and classes[before] != own:
                    key = before, place + depth
                    found[key] = min(found.get(key, reach), place - before)
            if at < n:
                behind = one[at]
                if behind - place <= reach and classes[behind] != own:
                    key = place, behind + depth
                    found[key] = min(found.get(key, reach), behind - place)
        if len(other) * 16 < n:
            for place in other:
                insort(one, place)
        else:
            one.extend(other)
            one.sort()
        return one

    for place, common in zip(places, shared):
        child = [place]
        while stack and stack[-1][0] > common:
            depth, node = stack.pop()
            child = join(node, child, depth)
        if stack and stack[-1][0] == common:
            depth, node = stack.pop()
            stack.append((depth, join(node, child, depth)))
        else:
            stack.append((common, child))


def find_runs(
    texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER
) -> list[list[tuple[int, int, int]]]:
    """Per text (a list of words) its runs as ``(start, length, period)``, in that order."""
    if least_power < 3:
        raise ValueError("runs of fewer than three periods are not found by this method")
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(words) for words in texts], np.int64)
    n = int(sizes.sum())
    if not n:
        return runs
    flat = pa.array([word for words in texts for word in words], pa.large_binary())
    codes = flat.dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), sizes)
    symbols = codes.indices.to_numpy().astype(np.int64) + owner * len(codes.dictionary)
    ends = np.repeat(np.cumsum(sizes), sizes)
    slots, order, shared = sorted_suffixes(symbols, ends, least_shared(least_length, least_power))
    if not len(slots):
        return runs
    # Only stretches of neighbours that share enough have nodes that matter.
    breaks = np.flatnonzero(np.diff(slots) > 1) + 1
    left = np.append(-1, symbols[:-1])
    found: dict[tuple[int, int], int] = {}
    for own, common in zip(np.split(slots, breaks), np.split(shared, breaks)):
        places = order[own[0] : own[-1] + 2]
        low = int(places.min())
        classes = left[low : int(places.max()) + 1].tolist()
        pairs: dict[tuple[int, int], int] = {}
        maximal_pairs((places - low).tolist(), [*common.tolist(), 0], classes, least_power, pairs)
        for (a, b), q in pairs.items():
            key = a + low, b + low
            found[key] = min(found.get(key, q), q)
    starts = np.cumsum(sizes) - sizes
    for (a, b), q in sorted(found.items()):
        if b - a >= max(least_length, least_power * q):
            text = int(owner[a])
            runs[text].append((a - int(starts[text]), b - a, q))
    for own in runs:
        own.sort(key=lambda run: (run[0], run[2]))
    return runs


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def periodic_runs(
    documents: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_power: int = LEAST_POWER,
    text: str = "text",
) -> DataFrame:
    """Every row with ``n_words``, its ``runs`` and its ``collapsed`` text.

    Words are separated by blanks and U+0009 to U+000D. A run has at least ``least_length``
    words and ``least_power`` (3 or more) periods, its period is the smallest that it has,
    and no neighbouring word continues it. ``runs`` are by start, then period; overlapping
    runs are all there. ``collapsed`` joins the words that are in no run, or in the first
    period of all runs that hold them, by one blank.

    All columns but the text stay (those named like the result's are replaced). Null and
    empty texts have no words, no runs and the empty text; repeated rows come back
    repeated, an empty table empty. Nothing is shuffled: a task holds the words of
    ``WORDS_AT_ONCE`` words' worth of texts, or of one longer text.
    """
    made = ("n_words", "runs", "collapsed")
    carried = [c for c in documents.columns if c != text and c not in made]
    # By position, so that no name of the input can clash with another.
    rows = documents.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)],
        F.col(f"`{text}`").cast("binary").alias("words"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            first = 0
            while first < batch.num_rows:
                # Without arguments, split() of bytes splits at the six characters above.
                words, n = [], 0
                while first + len(words) < batch.num_rows and (not words or n < WORDS_AT_ONCE):
                    words.append((texts[first + len(words)].as_py() or b"").split())
                    n += len(words[-1])
                found = find_runs(words, least_length, least_power)
                kept = [b" ".join(collapse(w, r)) for w, r in zip(words, found)]
                listed = pa.array(
                    [[{"start": s, "length": m, "period": q} for s, m, q in own] for own in found],
                    pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])),
                )
                part = batch.slice(first, len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([len(w) for w in words], pa.int64()),
                        listed,
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=[*part.schema.names[:-1], *made],
                )
                first += len(words)

    fields = ", ".join(
        f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carried))
    )
    schema = f"{fields}, {RUNS_SCHEMA}" if fields else RUNS_SCHEMA
    return rows.mapInArrow(scan, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *made
    )
