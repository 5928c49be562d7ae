"""Linked classes: tiles of candidate groups, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import salted, written

TILE_KEYS = ("lo", "hi")


def tiled(members: DataFrame, node: str, blocks: Column) -> DataFrame:
    """Cut groups of candidates into tiles.

    A group of ``blocks`` blocks becomes a tile for each pair of blocks, so that every
    pair of its members meets in a task, and a member goes to ``blocks`` tiles. Adds
    ``lo``, ``hi`` (the blocks of the tile) and ``block`` (the member's own).
    """
    block = F.pmod(salted(F.col(node), 1 << 30), blocks.cast("int"))
    spread = members.withColumn("block", block).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))
    )
    return spread.withColumns(
        {"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}
    ).drop("_other")


def groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal integer keys, from batches sorted by them."""
    waiting: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack(
            [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
        )
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            key = tuple(values[:, start].tolist())
            if waiting and key != current:
                yield current, pa.Table.from_batches(waiting)
                waiting = []
            current = key
            waiting.append(batch.slice(start, end - start))
    if waiting:
        yield current, pa.Table.from_batches(waiting)


class Forest:
    """Groups of the rows of a tile that links join; a group is named by its first row."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        names = np.unique(np.append(self.name[others], self.name[i]))
        if len(names) > 1:
            self.name[np.isin(self.name, names)] = names[0]

    def find(self, i: int) -> int:
        return int(self.name[i])


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, component``: the smallest node that can be reached, for nodes with edges.

    Alternates the large-star and small-star steps until the edges stay as they are;
    the number of rounds grows with the logarithm of the longest path. Edges never
    grow in number; each round is written to the shared folder.
    """

    def canonical(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).filter("u != v").distinct()

    def fingerprint(pairs: DataFrame):
        return pairs.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    now = written(canonical(edges.toDF("u", "v")), f"{label}-edges")
    seen = fingerprint(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u != v").distinct(), f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(
            canonical(small.union(low.select("u", F.col("m").alias("v")))), f"{label}-small"
        )
        after = fingerprint(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
