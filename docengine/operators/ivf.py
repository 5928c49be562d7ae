"""Approximate retrieval by an inverted file with quantised residuals.

Unit vectors are dealt over cells by their nearest trained centre; what is left of a vector
is cut into parts, and each part is stored as the number of its nearest codeword, a byte.
A question probes its nearest cells only. Scores are sums of table look-ups (the question
with every codeword of every part, made once per question); the best of them are scored
again exactly. Cells grow with the square root of the table and probes with the square root
of the cells, so the probed share falls as the table grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.operators.retrieval import (
    BLOCK_ROWS,
    HELD_BLOCKS,
    PASS_BYTES,
    SCORE_CELLS,
    SCORE_UNITS,
    best_positions,
    keep_best,
    matrix,
    meet,
    nearest_units,
    question_blocks,
    ranked_units,
    row_slices,
    unpacked,
)
from docengine.session import materialise, work_folder

# Bounds of the fit, which is the driver's: cells, rows of the sample per cell, codewords.
MOST_CELLS = 16384
SAMPLE_PER_CELL = 48
LEAST_SAMPLE = 8192
CODEWORDS = 256
PARTS = 8
ROUNDS = 8
# So many of the best quantised scores per result are scored exactly.
RESCORED = 10


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every point, in slices of a bounded size."""
    half = (centres**2).sum(axis=1) / 2
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate(
        [(points[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), step)]
        or [np.zeros(0, "int64")]
    )


def _k_means(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres, started from points spread evenly over the sample."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _closest(points, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        filled = count > 0
        centres[filled] = total[filled] / count[filled, None]
    return centres


class InvertedFile:
    """Codes of a table of vectors, stored by cell, with what was fitted for them."""

    def __init__(self, codes: DataFrame, vectors: DataFrame, key: str, vector: str, centres, books):
        self.codes, self.vectors, self.key, self.vector = codes, vectors, key, vector
        self.centres, self.books = centres, books

    @classmethod
    def build(
        cls, vectors: DataFrame, key: str = "uuid", vector: str = "embedding", cells: int | None = None
    ) -> InvertedFile:
        """Fit on a bounded sample (rows whose key's hash is below a threshold), then encode
        and store every row; rows without a vector of the common size are left out."""
        spark: SparkSession = vectors.sparkSession
        usable = vectors.filter(F.col(vector).isNotNull()).select(key, vector)
        size = usable.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
        n, dimensions = (size["count"], size["size"]) if size else (0, PARTS)
        cells = max(1, min(MOST_CELLS, cells or math.isqrt(n)))
        usable = usable.filter(F.size(vector) == dimensions)
        wanted = max(LEAST_SAMPLE, cells * SAMPLE_PER_CELL)
        chosen = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / max(1, n)))
        rows = usable.filter(chosen).select(vector).collect()
        sample = _unit(np.array([row[0] for row in rows] or [[0.0] * dimensions], dtype="float64"))
        centres = _k_means(sample, min(cells, len(sample)))
        left = sample - centres[_closest(sample, centres)]
        bounds = np.linspace(0, dimensions, min(PARTS, dimensions) + 1).astype(int)
        books = [
            _k_means(left[:, a:b], min(CODEWORDS, len(sample))) for a, b in zip(bounds, bounds[1:])
        ]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _unit(matrix(batch.column(vector)))
                cell = _closest(points, centres)
                rest = points - centres[cell]
                parts = [_closest(rest[:, a:b], book) for (a, b), book in zip(zip(bounds, bounds[1:]), books)]
                codes = np.stack(parts, axis=1).astype("uint8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=[key, "cell", "code"],
                )

        schema = T.StructType(
            [vectors.schema[key], T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType())]
        )
        # Files of whole cell ranges: a search reads the row groups of the cells it probes.
        place = work_folder(spark, "inverted-file")
        usable.mapInArrow(encode, schema).repartitionByRange("cell", key).sortWithinPartitions("cell").write.parquet(place)
        codes = spark.read.schema(schema).parquet(place)
        return cls(codes, vectors, key, vector, centres, books)

    def probes(self) -> int:
        """How many cells a question probes."""
        return min(len(self.centres), max(4, math.ceil(4 * math.sqrt(len(self.centres)))))

    def probing(self, questions: DataFrame, question: str, probes: int) -> DataFrame:
        """``question, vector, cell``: every question with each of its nearest cells."""
        centres, vector = self.centres, self.vector

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A slice's scores, and its vectors once per probed cell, have a bounded size.
            step = max(1, SCORE_CELLS // max(len(centres), probes * centres.shape[1]))
            half = (centres**2).sum(axis=1) / 2
            for batch in (each.slice(at, step) for each in batches for at in range(0, each.num_rows, step)):
                scores = _unit(matrix(batch.column(vector))) @ centres.T - half
                near = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(rows).columns, pa.array(near.ravel(), pa.int32())],
                    names=[*batch.schema.names, "cell"],
                )

        asked = questions.filter(F.size(vector) == centres.shape[1]).select(
            question, F.col(vector).cast("array<double>").alias(vector)
        )
        schema = T.StructType([*asked.schema.fields, T.StructField("cell", T.IntegerType())])
        return asked.mapInArrow(place, schema)

    def nearest(
        self, questions: DataFrame, k: int = 10, question: str = "question_id", probes: int | None = None,
        rescored: int = RESCORED, pass_bytes: int = PASS_BYTES,
    ) -> DataFrame:
        """About the k most similar rows per question: its id, ``rank``, key, ``score``.

        The scores are exact. ``probes`` of all cells and a ``rescored`` that covers the
        table make the result exact, too.
        """
        key, vector, centres, books = self.key, self.vector, self.centres, self.books
        probing = materialise(self.probing(questions, question, probes or self.probes()), "probing")
        # Numbers of cells, at most ``MOST_CELLS``, for the row groups that are read.
        wanted = [row["cell"] for row in probing.select("cell").distinct().collect()]
        pool = self.codes.filter(F.col("cell").isin(*wanted))
        asked, held_bytes = question_blocks(probing, question, vector, k * rescored)
        packed = _code_blocks(pool, key, centres.shape[1])
        depth = k * rescored
        schema = T.StructType([questions.schema[question], pool.schema[key], T.StructField("_units", T.LongType())])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, tuple] = {}
            kept: dict[tuple, list] = {}
            # Scores of a block's questions with all codewords, of the block asked last only.
            made: tuple = (None, [])
            ends = np.cumsum([0, *[book.shape[1] for book in books]])

            def results() -> Iterator[pa.RecordBatch]:
                for name, tables in kept.items():
                    best = keep_best(tables, depth, key)
                    ids = held[name][0].take(best.column("question").combine_chunks())
                    yield from pa.table([ids, best.column(key), best.column("units")], names=schema.names).to_batches()
                held.clear()
                kept.clear()

            for batch in batches:
                for i in range(batch.num_rows):
                    name = tuple(batch.column(c)[i].as_py() for c in ("cell", "block"))
                    if name not in held:
                        # Codes come by cell: what is held for others is not asked for again.
                        if len(held) == HELD_BLOCKS or any(other[0] != name[0] for other in held):
                            yield from results()
                        block = batch.column("questions")[i].values
                        points = _unit(matrix(block.field("vector")))
                        held[name] = block.field("id"), points @ centres[name[0]], points
                        kept[name] = []
                    ids, base, points = held[name]
                    if made[0] != name:
                        made = name, [points[:, a:b] @ book.T for a, b, book in zip(ends, ends[1:], books)]
                    rows = unpacked(batch.column("rows")[i])
                    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), "uint8").reshape(rows.num_rows, -1)
                    step = max(1, SCORE_CELLS // len(ids))
                    for at_row in range(0, rows.num_rows, step):
                        some = codes[at_row : at_row + step]
                        scores = np.zeros((len(ids), len(some)))
                        for m, table in enumerate(made[1]):
                            scores += table[:, some[:, m]]
                        scores += base[:, None]
                        units = np.rint(scores * SCORE_UNITS).astype("int64")
                        q, at = best_positions(units, depth)
                        found = pa.table(
                            [pa.array(q), pa.array(units[q, at]), rows.column(key).take(pa.array(at + at_row))],
                            names=["question", "units", key],
                        )
                        kept[name].append(found)
                        if sum(each.num_rows for each in kept[name]) > 2 * depth * len(ids):
                            kept[name] = [keep_best(kept[name], depth, key)]
            yield from results()

        met = meet(asked, held_bytes, pool, packed, pass_bytes)
        likely = materialise(
            ranked_units(met.mapInArrow(task, schema), question, key, depth).select(question, key), "likely"
        )
        return self._exactly(likely, questions, question, k)

    def _exactly(self, likely: DataFrame, questions: DataFrame, question: str, k: int) -> DataFrame:
        """The k best of likely pairs by their own vectors."""
        key, vector = self.key, self.vector
        asked = questions.select(question, F.col(vector).cast("array<double>").alias("_asked"))
        rows = self.vectors.select(key, F.col(vector).cast("array<double>").alias("_held"))
        pairs = likely.join(rows, key).join(asked, question)
        schema = T.StructType([questions.schema[question], self.vectors.schema[key], T.StructField("_units", T.LongType())])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (_unit(matrix(batch.column(c))) if batch.num_rows else np.zeros((0, 1)) for c in ("_asked", "_held"))
                units = np.rint((a * b).sum(axis=1) * SCORE_UNITS).astype("int64")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(question), batch.column(key), pa.array(units)], names=schema.names
                )

        best = ranked_units(pairs.select(question, key, "_asked", "_held").mapInArrow(score, schema), question, key, k)
        return best.select(question, "rank", key, F.round(F.col("_units") / SCORE_UNITS, 8).alias("score"))

    def recall(self, questions: DataFrame, k: int = 10, question: str = "question_id", **options) -> DataFrame:
        """Per question, how many of its k nearest the search finds: ``wanted, found``, and
        the share of all rows in the cells that it probes (``probed``)."""
        exact = nearest_units(questions, self.vectors, k, question, self.key, self.vector).select(question, self.key)
        got = self.nearest(questions, k, question, **options).select(question, self.key, F.lit(1).alias("_hit"))
        total = self.codes.count()
        sizes = self.codes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        probing = self.probing(questions, question, options.get("probes") or self.probes())
        share = probing.join(sizes, "cell").groupBy(question).agg((F.sum("n") / max(1, total)).alias("probed"))
        return (
            exact.join(got, [question, self.key], "left")
            .groupBy(question)
            .agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"))
            .join(share, question, "left")
        )


def _code_blocks(pool: DataFrame, key: str, size: int) -> DataFrame:
    """Codes packed where they are read: ``size, cell, number, rows``, one cell each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                rows = batch.take(pa.array(np.flatnonzero(cells == cell))).select([key, "code"])
                for part in row_slices(rows, key, BLOCK_ROWS):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "size": pa.array([size], pa.int32()),
                            "cell": pa.array([cell], pa.int32()),
                            "number": pa.array([task << 32 | number], pa.int64()),
                            "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        }
                    )
                    number += 1

    return pool.mapInArrow(pack, "size int, cell int, number long, rows binary")
