"""Best-fit packing of token sequences, in bulk-synchronous supersteps."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import parts_of, strings, written
from docengine.llm.graph import groups
from docengine.llm.tokenization import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"
SWEPT = (
    "kind int, id long, size long, sequence long, offset long, part int, seat long, slots long"
)
SWEPT_NAMES = [column.split()[0] for column in SWEPT.split(", ")]
DOCUMENT, GAP = 0, 1  # a document sorts before a gap of its size
SHORT = 8  # documents of up to this part of the capacity are the last band
RANGE_ROWS = 16_384  # documents and gaps of a range, more where there would be
MOST_RANGES = 16_384
PART_BYTES = 1 << 20  # texts that a task takes out of a batch at a time
TASK_BITS = 33  # pieces that one task can number


def token_pieces(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False
) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` to each document and cut
    only those longer than ``capacity``. ``number`` is the task's and the piece's place
    in it; the written pieces keep it."""
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << TASK_BITS
        for batch in parts_of(batches, PART_BYTES):
            columns: list[list] = [[] for _ in schema.split(",")]
            for doc_id, text in zip(
                batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            ):
                ids = encode(text) + end
                for start in range(0, len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    row = [doc_id, start // capacity, start, len(part) // 4, zlib.crc32(part)]
                    for column, value in zip(columns, [*row, number, part]):
                        column.append(value)
                    number += 1
            yield _batch(columns, with_ids)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, schema
    )


def _batch(columns: list[list], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
    if with_ids:
        kinds.append(pa.binary())
        names.append("ids")
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, kinds)], names=names
    )


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A number of sequences that documents of these lengths need at least.

    The largest of three bounds: all tokens; at most j documents longer than
    ``capacity / (j + 1)`` in a sequence; and, for every a up to half the capacity,
    documents longer than ``capacity - a`` alone, those longer than half apart, and
    what those of a and more do not find beside the latter.
    """
    n = np.zeros(capacity + 2, np.int64)
    for length, many in counts.items():
        n[length] = many
    longer = n[::-1].cumsum()[::-1]  # documents of a length or more
    tokens = (n * np.arange(capacity + 2))[::-1].cumsum()[::-1]
    best = -(-int(tokens[0]) // capacity)
    for j in range(1, capacity + 1):
        best = max(best, -(-int(longer[capacity // (j + 1) + 1]) // j))
    half = capacity // 2 + 1
    for a in range(1, capacity // 2 + 1):
        big = max(half, capacity - a + 1)
        room = int(longer[half] - longer[big]) * capacity - int(tokens[half] - tokens[big])
        rest = max(0, int(tokens[a] - tokens[half]) - room)
        best = max(best, int(longer[half]) - (-rest // capacity))
    return best


def sweep(lengths: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One successor sweep over sorted documents and gaps.

    Going up the sizes, a gap takes the longest document passed that no smaller gap
    took, so every document goes to the nearest gap above that shorter ranks leave
    it. A gap in which several of the longest document fit takes that many. Returns
    documents, their gaps and where in the gap each begins.
    """
    longest = int(lengths.max())
    slots = np.maximum(1, rooms // longest)
    # Of gaps that hold any document, the smallest that serve for all of them are enough.
    before = np.cumsum(np.where(rooms >= longest, slots, 0)) - slots
    slots = np.where((rooms >= longest) & (before >= len(lengths)), 0, slots)
    gap = np.repeat(np.arange(len(rooms)), slots)
    sizes = np.concatenate([lengths, rooms[gap]])
    sign = np.repeat([1, -1], [len(lengths), len(gap)])
    order = np.lexsort((-sign, sizes))
    sign = sign[order]
    # Pairs are neighbours among the events of one depth, like brackets.
    depth = np.cumsum(sign) + (sign < 0)
    by_depth = np.argsort(depth, kind="stable")
    depth, sign = depth[by_depth], sign[by_depth]
    met = np.flatnonzero((depth[:-1] == depth[1:]) & (sign[:-1] == 1) & (sign[1:] == -1))
    taken = order[by_depth[met]]
    taker = gap[order[by_depth[met + 1]] - len(lengths)]
    rank = np.lexsort((taken, taker))
    taken, taker = taken[rank], taker[rank]
    ends = np.cumsum(lengths[taken])
    first = np.flatnonzero(np.diff(taker, prepend=-1))
    base = (ends - lengths[taken])[first]
    at = ends - lengths[taken] - np.repeat(base, np.diff(np.append(first, len(taker))))
    return taken, taker, at


def sweeps(
    lengths: np.ndarray, rooms: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sweeps until no document fits into a gap: for each document its gap (or -1)
    and its offset in the sequence, and what the gaps have left."""
    gap_of, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    rooms = rooms.copy()
    waiting = np.argsort(lengths, kind="stable")
    while len(waiting):
        wide = np.flatnonzero(rooms >= lengths[waiting[0]])
        if not len(wide):
            break
        wide = wide[np.argsort(rooms[wide], kind="stable")]
        taken, taker, at = sweep(lengths[waiting], rooms[wide])
        taken_docs, takers = waiting[taken], wide[taker]
        gap_of[taken_docs] = takers
        offset[taken_docs] = capacity - rooms[takers] + at
        np.subtract.at(rooms, takers, lengths[taken_docs])
        left = np.ones(len(waiting), bool)
        left[taken] = False
        waiting = waiting[left]
    return gap_of, offset, rooms


def _superstep(capacity: int, longest: int):
    """Task code: sweeps over one range of sorted documents and gaps. What stays is
    numbered for the ranges beyond: waiting documents from the longest down, places in
    untouched gaps upwards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), table in groups(batches, ["part"]):
            yield one(part, table)

    def one(part: int, table: pa.Table) -> pa.RecordBatch:
        kind, number, size = (table.column(c).to_numpy() for c in ("kind", "id", "size"))
        docs, gaps = np.flatnonzero(kind == DOCUMENT), np.flatnonzero(kind == GAP)
        gap_of, offset, rooms = sweeps(size[docs], size[gaps], capacity)
        placed = gap_of >= 0
        sequence = np.zeros(len(docs), np.int64)
        sequence[placed] = number[gaps[gap_of[placed]]]
        slots = np.where(rooms == size[gaps], np.maximum(1, rooms // longest), 0)
        docs_seat = np.cumsum(~placed[::-1])[::-1] - 1
        columns = {
            "kind": kind[np.concatenate([docs, gaps])],
            "id": number[np.concatenate([docs, gaps])],
            "size": np.concatenate([size[docs], rooms]),
            "offset": np.concatenate([offset, np.zeros(len(gaps), np.int64)]),
            "part": np.full(len(kind), part, np.int32),
            "seat": np.concatenate([docs_seat, np.cumsum(slots) - slots]),
            "slots": np.concatenate([np.zeros(len(docs), np.int64), slots]),
        }
        found = pa.array(
            np.concatenate([sequence, np.zeros(len(gaps), np.int64)]),
            mask=np.concatenate([~placed, np.ones(len(gaps), bool)]),
        )
        return pa.RecordBatch.from_pydict(
            {**{name: pa.array(values) for name, values in columns.items()}, "sequence": found}
        ).select(SWEPT_NAMES)

    return task


def carried(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which waiting documents meet which places of higher ranges.

    ``parts`` has a range's number, its free places and its waiting documents. The
    same sweep over ranges: places take the documents of the nearest range below.
    Rows: range and first seat of the documents, how many, range and first seat of
    the places; fewer than two for each range.
    """
    stack: list[list[int]] = []
    runs = []
    for part, places, documents in sorted(parts):
        at = 0
        while at < places and stack:
            below, seat, left = stack[-1]
            n = min(places - at, left)
            runs.append((below, seat, n, part, at))
            at += n
            if n == left:
                stack.pop()
            else:
                stack[-1] = [below, seat + n, left - n]
        if documents:
            stack.append([part, 0, documents])
    return runs


def _carry(
    waiting: DataFrame, gaps: DataFrame, runs: list[tuple], capacity: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents meet places of higher ranges by an equality join on range and seat:
    those placed, those that still wait, and the gaps as they are then."""
    spark = waiting.sparkSession
    run = F.broadcast(
        spark.createDataFrame(runs, "from_part int, from_seat long, n long, to_part int, to_seat long")
    )
    inside = (F.col("part") == F.col("from_part")) & (
        (F.col("seat") >= F.col("from_seat")) & (F.col("seat") < F.col("from_seat") + F.col("n"))
    )
    met = waiting.join(run, inside, "left")
    still = met.filter(F.col("n").isNull()).select("kind", "id", "size")
    wanted = met.filter(F.col("n").isNotNull()).select(
        "id", "size", F.col("to_part").alias("part"),
        (F.col("to_seat") + F.col("seat") - F.col("from_seat")).alias("seat"),
    )
    reached = (F.col("slots") > 0) & (F.col("part") == F.col("to_part")) & (
        (F.col("seat") < F.col("to_seat") + F.col("n"))
        & (F.col("seat") + F.col("slots") > F.col("to_seat"))
    )
    first = F.greatest("seat", "to_seat")
    last = F.least(F.col("seat") + F.col("slots"), F.col("to_seat") + F.col("n")) - 1
    places = gaps.join(run, reached).select(
        F.col("id").alias("sequence"), F.col("size").alias("room"), "part",
        F.explode(F.sequence(first, last)).alias("seat"),
    )
    # At most ``capacity`` documents meet in one sequence.
    earlier = Window.partitionBy("sequence").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(
        wanted.join(places, ["part", "seat"]).select(
            "id",
            "size",
            "sequence",
            (capacity - F.col("room") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("offset"),
        ),
        "carried",
    )
    used = placed.groupBy(F.col("sequence").alias("id")).agg(F.sum("size").alias("used"))
    gaps = gaps.join(used, "id", "left").select(
        "kind", "id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")
    )
    return placed, still, gaps


def _ranged(events: DataFrame, counts: dict[tuple[int, int], int], rows: int) -> DataFrame:
    """Documents and gaps sorted into ranges by size, ``counts`` by size and kind. Those
    alike in both are spread by a hash over the ranges that their number takes."""
    total = sum(counts.values())
    rows = max(rows, -(-total // MOST_RANGES))
    classes, start = [], 0
    for (size, kind), n in sorted(counts.items()):
        classes.append((kind, size, start, n))
        start += n
    # Two rows at most for each size up to the capacity.
    table = events.sparkSession.createDataFrame(classes, "kind int, size long, start long, n long")
    part = (F.col("start") + F.pmod(F.xxhash64("id"), F.col("n"))) / rows
    return (
        events.join(F.broadcast(table), ["kind", "size"])
        .select("kind", "id", "size", F.floor(part).cast("int").alias("part"))
        .repartition(-(-total // rows), "part")
        .sortWithinPartitions("part", "kind", "size", "id")
    )


def place_best_fit(documents: DataFrame, capacity: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Bulk-synchronous best fit: ``id, sequence, offset`` for documents ``id, size``.

    Documents come in bands, those longer than half of the longest that is left, then
    all short ones, so that these fill what long ones leave. A superstep range-sorts the waiting documents
    of the band and the gaps by size, so that each range is swept by a task of its own
    (``sweeps``); documents and untouched gaps that a range has left meet those of other
    ranges by rank (``carried``); gaps are updated and written, and the next superstep
    begins. Sequences are opened only for documents longer than every gap, as many as
    these need at the least (``least_sequences``). Every superstep places a document,
    as one fits into the largest gap by then.

    The driver holds two numbers for each size up to ``capacity`` and for each range.
    """
    spark = documents.sparkSession
    documents = documents.select(F.lit(DOCUMENT).alias("kind"), "id", "size")
    later = {row["size"]: row["n"] for row in documents.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    waiting = documents.limit(0)
    gaps = waiting
    done, opened = [], 0
    while True:
        events = waiting.unionByName(gaps)
        counts = events.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()
        band = {row["size"]: row["n"] for row in counts if row["kind"] == DOCUMENT}
        widest = max((row["size"] for row in counts if row["kind"] == GAP), default=0)
        if not band:
            if not later:
                break
            half = max(later) // 2 if max(later) > capacity // SHORT else 0
            waiting = documents.filter(F.col("size").between(half + 1, max(later)))
            band = {length: n for length, n in later.items() if length > half}
            later = {length: n for length, n in later.items() if length <= half}
        least = min([*band, *later])
        gaps = gaps.filter(F.col("size") >= least)
        sorted_counts = Counter({(length, DOCUMENT): n for length, n in band.items()})
        for row in counts:
            if row["kind"] == GAP and row["size"] >= least:
                sorted_counts[row["size"], GAP] = row["n"]
        events = waiting.unionByName(gaps)
        stuck = {length: n for length, n in {**later, **band}.items() if length > widest}
        if stuck:
            many = least_sequences(stuck, capacity)
            new = spark.range(opened, opened + many).select(
                F.lit(GAP).alias("kind"), "id", F.lit(capacity).cast("long").alias("size")
            )
            events, opened = events.unionByName(new), opened + many
            sorted_counts[capacity, GAP] += many
        swept = written(
            _ranged(events, sorted_counts, range_rows).mapInArrow(_superstep(capacity, max(band)), SWEPT),
            "swept",
        )
        done.append(swept.filter(F.col("sequence").isNotNull()).select("id", "sequence", "offset"))
        waits = (F.col("kind") == DOCUMENT) & F.col("sequence").isNull()
        waiting, gaps = swept.filter(waits), swept.filter((F.col("kind") == GAP) & (F.col("size") > 0))
        seats = swept.groupBy("part").agg(
            F.sum("slots").alias("slots"), F.count(F.when(waits, 1)).alias("left")
        )
        runs = carried([(row["part"], row["slots"], row["left"]) for row in seats.collect()])
        if runs:
            placed, waiting, gaps = _carry(waiting, gaps, runs, capacity)
            done.append(placed.select("id", "sequence", "offset"))
        waiting, gaps = waiting.select("kind", "id", "size"), gaps.select("kind", "id", "size")
    if not done:
        return spark.createDataFrame([], "id long, sequence long, offset long")
    return reduce(DataFrame.unionByName, done)


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into few sequences of at most ``capacity`` tokens, by best fit.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids`` where asked for). Texts are encoded once, where they are read, and
    never shuffled; what is sorted and matched are numbers and lengths
    (``place_best_fit``). Documents of one length are told apart by their number, so a
    length which a third of all documents share is spread over ranges like any other.

    Null texts are empty: a single ``end_id``. Repeated rows, and rows whose id is
    null, are packed as documents of their own. An empty table gives no rows. Other
    columns are ignored, whatever their names. Sequence numbers have no order.
    """
    pieces = written(
        token_pieces(documents, tokenizer, end_id, capacity, with_ids), "token-pieces", of_texts=True
    )
    places = place_best_fit(
        pieces.select(F.col("number").alias("id"), F.col("length").alias("size")), capacity
    )
    places = places.select(F.col("id").alias("number"), F.col("sequence").alias("sequence_id"), "offset")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return pieces.join(places, "number").select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: the ids of
    every sequence as little-endian unsigned 32-bit integers, at most ``capacity``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda out, part: F.concat(out, part["ids"])).alias("ids"),
        F.sum("length").alias("length"),
    )
