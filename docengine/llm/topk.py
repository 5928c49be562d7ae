"""Exact top-k search by inner product: a KD-tree per shard, best-first traversal."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import written

SCALE = 256
SHARD_ROWS = 8192
LEAF_ROWS = 64
SHARDS_PER_GROUP = 16
QUERIES_PER_BLOCK = 2048
BLOCKS_AT_ONCE = 64
LEAST = -(1 << 63)  # stands for a floor that is not known


def build_tree(points: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> dict:
    """Median splits along the widest side; every node has the tight box of its points.

    Nodes are numbered so that a node's children follow it; ``left`` is -1 at leaves,
    whose points are the rows ``start`` to ``end`` of the reordered arrays.
    """
    order = np.arange(len(points))
    low, high, left, right, start, end = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        own = points[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        left.append(-1)
        right.append(-1)
        start.append(a)
        end.append(b)
        return len(left) - 1

    waiting = [add(0, len(points))]
    while waiting:
        node = waiting.pop()
        a, b = start[node], end[node]
        side = high[node] - low[node]
        if b - a <= LEAF_ROWS or not side.max():
            continue
        own = order[a:b]
        middle = (b - a) // 2
        order[a:b] = own[np.argpartition(points[own, side.argmax()], middle, kind="introselect")]
        left[node], right[node] = add(a, a + middle), add(a + middle, b)
        waiting += [left[node], right[node]]
    return {
        "points": points[order], "ids": ids[order], "copies": copies[order],
        "low": np.array(low), "high": np.array(high), "left": left, "right": right,
        "start": start, "end": end,
    }


class Best:
    """The k best of a query so far, by score, then by the smaller id; ``floor`` is a
    score that k candidates are known to reach."""

    __slots__ = ("k", "floor", "heap")

    def __init__(self, k: int, floor: int = LEAST):
        self.k, self.heap = k, []
        self.floor = floor if floor > LEAST else float("-inf")

    def offer(self, score: int, vec_id: int, copies: int) -> None:
        item = (score, -vec_id)
        for _ in range(min(copies, self.k)):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, item)
            elif item > self.heap[0]:
                heapq.heapreplace(self.heap, item)
            else:
                return
        if len(self.heap) == self.k:
            self.floor = max(self.floor, self.heap[0][0])


def search_tree(tree: dict, queries: np.ndarray, ids: np.ndarray, best: list[Best]) -> int:
    """Best-first search of every query; returns how many points were scored.

    A node's bound is the largest inner product that a point in its box could have.
    Nodes are visited by falling bound until it is below what k candidates reach; equal
    bounds are visited, because a smaller id wins a tie. A query is searched in doubles,
    in 64-bit or in Python integers, whichever holds all its sums exactly.
    """
    largest = np.abs(tree["points"].astype(np.float64)).max(initial=0)
    most = np.abs(queries.astype(np.float64)).sum(axis=1) * largest
    scored = 0
    for dtype, least, below in (
        (np.float64, -1, 2.0**52), (np.int64, 2.0**52, 2.0**62), (object, 2.0**62, np.inf),
    ):
        own = np.flatnonzero((most >= least) & (most < below))
        if len(own):
            scored += _search(tree, queries[own], ids[own], [best[i] for i in own], dtype)
    return scored


def _search(tree: dict, queries: np.ndarray, ids: np.ndarray, best: list[Best], dtype) -> int:
    kind = np.float64 if dtype is object else dtype
    low, high = tree["low"].astype(kind), tree["high"].astype(kind)
    asked = queries.astype(kind)
    bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    if dtype is object:  # rounded bounds must not be too low
        bounds += 1e-9 * (np.abs(asked) @ np.maximum(np.abs(low), np.abs(high)).T)
    points, queries = tree["points"].astype(dtype), queries.astype(dtype)
    left, right, start, end = tree["left"], tree["right"], tree["start"], tree["end"]
    scored = 0
    for q, (own, found) in enumerate(zip(ids.tolist(), best)):
        bound, query = bounds[q].tolist(), queries[q]
        waiting = [(-bound[0], 0)]
        while waiting and -waiting[0][0] >= found.floor:
            _, node = heapq.heappop(waiting)
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    if bound[child] >= found.floor:
                        heapq.heappush(waiting, (-bound[child], child))
                continue
            a, b = start[node], end[node]
            scores = points[a:b] @ query
            scored += b - a
            for i in np.flatnonzero(scores >= found.floor).tolist():
                vec_id = int(tree["ids"][a + i])
                if vec_id != own:
                    found.offer(int(scores[i]), vec_id, int(tree["copies"][a + i]))
    return scored


def _narrow(values: np.ndarray) -> np.ndarray:
    """As 32-bit integers where all fit, else as 64-bit ones."""
    fits = values.min(initial=0) >= -(1 << 31) and values.max(initial=0) < 1 << 31
    return values.astype("<i4" if fits else "<i8")


def _scaled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, size, vector`` (32-bit integers, or 64-bit ones for a vector that needs
    them), ``copies`` of usable vectors."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, vectors = [], [], []
            for vec_id, raw in zip(
                batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()
            ):
                if vec_id is None or not raw or any(x is None for x in raw):
                    continue
                row = np.asarray(raw, np.float64)
                if not np.isfinite(row).all():
                    continue
                with np.errstate(over="ignore"):
                    row = np.floor(row * SCALE)
                if row.min() < -(2.0**63) or row.max() >= 2.0**63:
                    raise ValueError(f"vector {vec_id}: a scaled component is no 64-bit integer")
                ids.append(vec_id)
                sizes.append(len(row))
                vectors.append(_narrow(row.astype(np.int64)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())],
                names=["vec_id", "size", "vector"],
            )

    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")
    ).mapInArrow(scale, "vec_id long, size int, vector binary")
    return written(
        rows.groupBy("vec_id", "size", "vector").agg(F.count(F.lit(1)).alias("copies")), "scaled"
    )


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k best other vectors of every query: ``query_id, rank, vec_id, score``.

    Components become ``floor(256 * x)``; the score is the integer inner product, ties
    go to the smaller id. Vectors that are null, empty, or hold null or non-finite
    components take no part, nor do rows without an id. A scaled component that is no
    64-bit integer is an error, and so is such a score among the k best of a task. Vectors of another size are no candidates. Rows of the query's own
    id are not candidates; other rows that repeat fill as many ranks. A query id with
    several vectors is searched with each, its ranks are over all of them. No
    candidates, no rows.

    Shards of a bounded number of rows each get a tree; a query block meets every
    group of shards in a task. First each block searches one shard; the k-th score
    found there goes with it to all others, and within a task from shard to shard.
    """
    vectors = _scaled(embeddings)
    counts = {
        row["size"]: -(-row["n"] // SHARD_ROWS)
        for row in vectors.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    queries = vectors.filter(is_query)
    if not counts:
        return vectors.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id",
            F.lit(0).cast("long").alias("score"),
        ).limit(0)
    shards_of = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("size")]
    own = F.xxhash64("vec_id", "vector")
    shards = written(
        vectors.withColumn("shard", F.pmod(own, shards_of).cast("int"))
        .groupBy("size", "shard")
        .applyInArrow(_shard_tree, "size int, shard int, tree binary")
        .withColumn("part", F.floor(F.col("shard") / SHARDS_PER_GROUP).cast("int")),
        "trees",
    )
    asked = queries.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks_of = {row["size"]: -(-row["n"] // QUERIES_PER_BLOCK) for row in asked}
    if not blocks_of:
        blocks_of = {0: 1}
    block_count = F.create_map(*[F.lit(x) for pair in blocks_of.items() for x in pair])
    blocks = written(
        queries.withColumn(
            "block", F.pmod(F.xxhash64("vector", "vec_id"), block_count[F.col("size")]).cast("int")
        )
        .groupBy("size", "block")
        .applyInArrow(_query_block, "size int, block int, queries binary"),
        "query-blocks",
    )
    at_home = F.pmod(F.col("block"), shards_of).cast("int")
    schema = "query_id long, vec_id long, score long, size int, block int, query int"
    home = written(
        blocks.withColumn("shard", at_home)
        .withColumn("floors", F.lit(None).cast("array<long>"))
        .join(shards, ["size", "shard"])
        .select("size", "block", "queries", "floors", "tree")
        .mapInArrow(_searcher(k), schema),
        "first-shards",
    )
    floors = (
        home.groupBy("size", "block", "query")
        .agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
        .groupBy("size", "block")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("query", F.when(F.col("n") == k, F.col("score")).otherwise(LEAST))
                )
            ).alias("known")
        )
        .select("size", "block", F.map_from_entries("known").alias("known"))
    )
    groups_of = F.ceil(shards_of / SHARDS_PER_GROUP).cast("int")
    known = (
        blocks.join(floors, ["size", "block"], "left")
        .withColumn("home", at_home)
        .withColumn(
            "floors",
            F.transform(
                F.sequence(F.lit(0), F.lit(QUERIES_PER_BLOCK * 2)),
                lambda i: F.coalesce(F.col("known")[i], F.lit(LEAST)),
            ),
        )
        .withColumn("part", F.explode(F.sequence(F.lit(0), groups_of - 1)))
        .select("size", "part", "block", "home", "queries", "floors")
    )
    rest = (
        known.join(shards, ["size", "part"])
        .filter(F.col("shard") != F.col("home"))
        .select("size", "block", "queries", "floors", "tree")
        .mapInArrow(_searcher(k), schema)
    )
    found = home.union(rest).select("query_id", "vec_id", "score")
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    )
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _points(table: pa.Table, size: int) -> np.ndarray:
    raw = table.column("vector").to_pylist()
    return np.array([np.frombuffer(v, f"<i{len(v) // size}") for v in raw], np.int64)


def _shard_tree(key: tuple, table: pa.Table) -> pa.Table:
    tree = build_tree(
        _points(table, key[0].as_py()),
        table.column("vec_id").to_numpy(),
        table.column("copies").to_numpy(),
    )
    for name in ("points", "low", "high"):
        tree[name] = _narrow(tree[name])
    return pa.table(
        {
            "size": pa.array([key[0].as_py()], pa.int32()),
            "shard": pa.array([key[1].as_py()], pa.int32()),
            "tree": pa.array([pickle.dumps(tree)], pa.binary()),
        }
    )


def _query_block(key: tuple, table: pa.Table) -> pa.Table:
    asked = (table.column("vec_id").to_numpy(), _narrow(_points(table, key[0].as_py())))
    return pa.table(
        {
            "size": pa.array([key[0].as_py()], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int32()),
            "queries": pa.array([pickle.dumps(asked)], pa.binary()),
        }
    )


def _searcher(k: int):
    """Task code: carries every block's best from shard to shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("size")[i].as_py(), batch.column("block")[i].as_py())
                if key not in state:
                    if len(state) >= BLOCKS_AT_ONCE:
                        yield from _results(state)
                        state = {}
                    ids, asked = pickle.loads(batch.column("queries")[i].as_py())
                    floors = batch.column("floors")[i].as_py() or []
                    floors += [LEAST] * (len(ids) - len(floors))
                    state[key] = ids, asked, [Best(k, f) for f in floors[: len(ids)]]
                ids, asked, best = state[key]
                search_tree(pickle.loads(batch.column("tree")[i].as_py()), asked, ids, best)
        yield from _results(state)

    return search


def _results(state: dict) -> Iterator[pa.RecordBatch]:
    for (size, block), (ids, _, best) in state.items():
        rows = [
            (query_id, -negative, score, size, block, q)
            for q, (query_id, found) in enumerate(zip(ids.tolist(), best))
            for score, negative in found.heap
        ]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        if any(not LEAST <= row[2] < -LEAST for row in rows):
            raise ValueError("a score is no 64-bit integer")
        columns = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)],
            names=["query_id", "vec_id", "score", "size", "block", "query"],
        )
