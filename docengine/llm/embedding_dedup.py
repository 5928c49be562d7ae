"""Near-duplicate vectors: spherical k-means cells, blocked cosines, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import join_by_hot_key, written
from docengine.llm.graph import Forest, components, groups, tiled

SIMILARITY = 0.9
SAMPLE = 16_384  # vectors that the centres are fitted on
CELL_VECTORS = 512  # wanted per cell
MOST_CELLS = 4096
CHOSEN = 0  # as many probes as ``RECALL`` needs
RECALL = 0.995  # of pairs as similar as asked for, estimated on the sample
TRIED = 2048  # sampled vectors that the estimate takes
PROBES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)  # cells that a vector is compared in
REACHES = (0.1, 0.2, 0.35, 0.7, 2.0)  # further cells count while their cosine is this near to the best one's
CLOSE = (2.0, 0.95, 0.9, 0.8, 0.7, -2.0)  # centres with this cosine to a leading one are of its cell
EXACT_CLOSE = 0.8
TILE_ROWS = 1024
ROUNDS = 8
SEED = 11


def unit_rows(vectors: list) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for null and zero vectors and
    those that hold null or non-finite components."""
    out: list[np.ndarray | None] = []
    for vector in vectors:
        if vector is None or not len(vector) or any(x is None for x in vector):
            out.append(None)
            continue
        row = np.asarray(vector, np.float64)
        largest = np.abs(row).max()
        if not np.isfinite(largest) or largest == 0:
            out.append(None)
            continue
        row = row / largest  # keeps squares in range
        out.append(row / np.sqrt(row @ row))
    return out


def fit_centres(sample: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: centres of length one, by cosine."""
    random = np.random.default_rng(seed)
    k = min(k, len(sample))
    centres = sample[random.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate(
            [(part @ centres.T).argmax(axis=1) for part in np.array_split(sample, len(sample) // 2048 + 1)]
        )
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        full = length > 1e-12
        centres = np.where(full[:, None], sums / np.where(full, length, 1)[:, None], centres)
    return centres


def merged_centres(cosines: np.ndarray, weight: np.ndarray, close: float) -> tuple[np.ndarray, np.ndarray]:
    """An order of the centres in which those of one cell are neighbours, and where each
    cell starts. The heaviest centre that is left leads the next cell and takes all that
    are left within ``close`` of it, so no cell is wider than that."""
    cell = np.full(len(cosines), -1)
    for leader in np.argsort(-weight, kind="stable").tolist():
        if cell[leader] < 0:
            cell[(cosines[leader] >= close) & (cell < 0)] = leader
            cell[leader] = leader
    order = np.argsort(cell, kind="stable")
    return order, np.unique(cell[order], return_index=True)[1]


def likely_pairs(
    sample: np.ndarray, similarity: float, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors ``a``, a partner ``b`` of each at ``similarity`` or more, and which
    partners are from the sample.

    A vector has one pair with a random neighbour, if the sample holds any, and one at
    exactly ``similarity`` on the way to a random other vector, so that it lies where
    the data lie, also where these share a direction.
    """
    random = np.random.default_rng(seed)
    chosen = random.permutation(len(sample))[:TRIED]
    real: list[tuple[int, int]] = []
    for part in np.array_split(chosen, len(chosen) // 256 + 1):
        near = sample[part] @ sample.T >= similarity
        near[np.arange(len(part)), part] = False
        for i, row in zip(part.tolist(), near):
            if row.any():
                real.append((i, int(random.choice(np.flatnonzero(row)))))
    a, other = sample[chosen], sample[random.integers(0, len(sample), len(chosen))]
    cosine = (a * other).sum(axis=1)
    away = other - cosine[:, None] * a
    length = np.sqrt((away * away).sum(axis=1))
    apart = (cosine < similarity) & (length > 1e-9)
    a, away = a[apart], away[apart] / length[apart, None]
    made = similarity * a + np.sqrt(max(0.0, 1 - similarity**2)) * away
    own, partner = np.array(real, np.int64).reshape(-1, 2).T
    return (
        np.concatenate([sample[own], a]),
        np.concatenate([sample[partner], made]),
        np.arange(len(own) + len(a)) < len(own),
    )


def _ranked(near: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest cells of each row and how much farther they are than the first."""
    near = np.maximum.reduceat(near, starts, axis=1)
    best = np.argsort(-near, axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(near, best, axis=1)
    return best, value[:, :1] - value


def chosen_cells(
    sample: np.ndarray, centres: np.ndarray, n: int, similarity: float, recall: float = RECALL, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Centres by cell, where cells start, probes and reach: of all ways that find
    ``recall`` of the sample's pairs, both real and made, the one that compares least of
    ``n`` vectors. One cell of everything is among the ways, so one is always found."""
    cosines = centres @ centres.T
    weight = np.zeros(len(centres), np.int64)
    for part in np.array_split(sample, len(sample) // 2048 + 1):
        weight += np.bincount((part @ centres.T).argmax(axis=1), minlength=len(centres))
    a, b, real = likely_pairs(sample, similarity, seed)
    rows = sample[np.random.default_rng(seed).permutation(len(sample))[:TRIED]]
    near_a, near_b, near_rows = a @ centres.T, b @ centres.T, rows @ centres.T
    ways = []
    for close in CLOSE:
        order, starts = merged_centres(cosines, weight, close)
        most = min(PROBES[-1], len(starts))
        cells_a, behind_a = _ranked(near_a[:, order], starts, most)
        cells_b, behind_b = _ranked(near_b[:, order], starts, most)
        cells, behind = _ranked(near_rows[:, order], starts, most)
        places = np.arange(1, most + 1)
        later = np.maximum(places[:, None], places)
        for reach in REACHES:
            needed = np.zeros(len(a), np.int64)  # probes that a pair is found with
            for start in range(0, len(a), 256):
                part = slice(start, start + 256)
                own = np.where(behind_a[part] <= reach, cells_a[part], -1)
                other = np.where(behind_b[part] <= reach, cells_b[part], -2)
                met = own[:, :, None] == other[:, None, :]
                needed[part] = np.where(met, later, most + 1).min(axis=(1, 2), initial=most + 1)
            for probes in PROBES:
                found = needed <= min(probes, most)
                if all(found[kind].mean() >= recall for kind in (real, ~real) if kind.any()):
                    inside = cells[:, :probes][behind[:, :probes] <= reach]
                    held = np.bincount(inside, minlength=len(starts)) * (n / len(rows))
                    ways.append(((held * held).sum() / 2 + CELL_VECTORS * held.sum(), close, probes, reach))
                    break
    _, close, probes, reach = min(ways)
    order, starts = merged_centres(cosines, weight, close)
    return centres[order], starts, probes, reach


def linked_vectors(
    embeddings: DataFrame,
    similarity: float = SIMILARITY,
    probes: int | None = CHOSEN,
    cell_vectors: int = CELL_VECTORS,
    recall: float = RECALL,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors with a cosine of ``similarity`` or more, in double precision, are linked.
    Centres are fitted on a bounded sample (``SAMPLE`` vectors, by hash of the id), one
    for ``cell_vectors`` vectors. Centres that lie close to a leading one are its cell, so that a dense group is
    compared whole, and every vector is put into its nearest cells, because a pair may lie on both sides of
    a border. How close, and how many cells, is what compares least among the ways that find ``recall`` of
    the pairs on the sample (``chosen_cells``); ``probes`` fixes the number of cells. With
    ``probes`` None no link is missed: a vector is put into every cell that can
    hold one within the angle of ``similarity``, by the radii of the cells (on data without
    groups that is most of them). Within a cell, cosines are matrix products of tiles; pairs are counted,
    not put out, in the first cell that both share. No wrong link is possible;
    recall against brute force is measured in the tests.

    Equal vectors are one class from the start, so a vector that a third of the rows
    hold is compared once. Null and zero vectors, and those with null or non-finite
    components, link with nothing: 0 links, component their own id, kept. Vectors of
    different sizes never link. ``vec_id`` may repeat; its rows are rows of their own.
    A null id takes part, and is kept only where its component has no other id. An
    empty table gives no rows. Other columns are ignored.
    """
    schema = "vec_id long, digest binary, vector binary, size int"

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("embedding").to_pylist())
            raw = [None if row is None else row.astype("<f8").tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([r if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
                    pa.array(raw, pa.binary()),
                    pa.array([None if row is None else len(row) for row in rows], pa.int32()),
                ],
                names=["vec_id", "digest", "vector", "size"],
            )

    rows = written(
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")
        ).mapInArrow(normalise, schema),
        "unit-vectors",
    )
    classes = written(
        rows.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("vec_id").alias("class_id"),
            F.any_value("vector").alias("vector"),
            F.any_value("size").alias("size"),
        ),
        "vector-classes",
    )
    links = written(_links(classes, similarity, probes, cell_vectors, recall), "vector-links")
    edges = links.filter(F.col("digest") != F.col("root")).select("digest", "root")
    found = components(edges, "vectors").withColumnRenamed("node", "digest")
    smallest = (
        found.join(classes.select("digest", "class_id"), "digest")
        .groupBy("component")
        .agg(F.min("class_id").alias("component_id"))
    )
    linked = (
        links.groupBy("digest")
        .agg(F.sum("n_links").alias("n_links"))
        .join(found.join(smallest, "component"), "digest", "left")
    )
    component = F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("component_id"))
    table = written(
        classes.join(linked, "digest", "left").select(
            "digest",
            "copies",
            (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            component.alias("component_id"),
        ),
        "vector-results",
    )
    own = rows.select("vec_id", "digest")
    # A vector that very many rows hold meets its class by a broadcast of few such classes.
    named = join_by_hot_key(own.filter(F.col("digest").isNotNull()), table, "digest", "copies")
    alone = own.filter(F.col("digest").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        named.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _distances(shared):
    """Task code: each vector's own cell, and its cosine with the nearest of its centres."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector").to_pylist()
            for size in np.unique(sizes).tolist():
                first, fitted, starts, *_ = shared.value[size]
                own = np.flatnonzero(sizes == size)
                for at in np.array_split(own, len(own) // 1024 + 1):
                    if len(at):
                        near = np.array([np.frombuffer(vectors[i], "<f8") for i in at]) @ fitted.T
                        near = np.maximum.reduceat(near, starts, axis=1)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "cell": pa.array(near.argmax(axis=1) + first, pa.int32()),
                                "cosine": pa.array(near.max(axis=1), pa.float64()),
                            }
                        )

    return task


def _links(
    classes: DataFrame, similarity: float, fixed_probes: int | None, cell_vectors: int, recall: float
) -> DataFrame:
    """Per tile and class: ``digest, n_links, root``."""
    spark = classes.sparkSession
    counts = {row["size"]: row["n"] for row in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    # By a threshold on the hash, so that no task sends more than its share; a few standard
    # deviations more than SAMPLE arrive at most.
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))
    chosen = F.pmod(F.xxhash64("digest"), F.lit(1 << 40)) < int((1 << 40) * share)
    sample = classes.filter(chosen).select("size", "vector").collect()
    centres, base = {}, 0
    for size, n in sorted(counts.items()):
        own = [np.frombuffer(row["vector"], "<f8") for row in sample if row["size"] == size]
        k = min(MOST_CELLS, max(1, n // cell_vectors))
        fitted = fit_centres(np.array(own), k) if own else np.zeros((1, size))
        starts, least, reach = np.zeros(1, np.int64), 1, REACHES[-1]
        if fixed_probes is None:
            order, starts = merged_centres(fitted @ fitted.T, np.ones(len(fitted)), EXACT_CLOSE)
            fitted = fitted[order]
        elif len(fitted) > 1:
            fitted, starts, least, reach = chosen_cells(np.array(own), fitted, n, similarity, recall)
        centres[size] = (base, fitted, starts, fixed_probes or least, reach)
        base += len(starts)
    shared = spark.sparkContext.broadcast(centres)  # MOST_CELLS vectors per size
    radii = None
    if fixed_probes is None:
        # How far the vectors of a cell lie from the nearest of its centres, one number each.
        found = classes.select("size", "vector").mapInArrow(_distances(shared), "cell int, cosine double")
        radii = np.full(max(1, base), -1.0)
        for row in found.groupBy("cell").agg(F.min("cosine").alias("cosine")).collect():
            radii[row["cell"]] = np.arccos(min(1.0, row["cosine"]))
        # A vector meets every cell that can hold one within the angle of ``similarity``.
        reach = np.where(radii < 0, -1.0, radii) + np.arccos(min(1.0, similarity)) + 1e-6
        radii = np.where(radii < 0, 2.0, np.cos(np.minimum(np.pi, reach)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * batch.num_rows
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            vectors = batch.column("vector").to_pylist()
            for size in np.unique(sizes).tolist():
                first, fitted, starts, probes, reach = shared.value[size]
                own = np.flatnonzero(sizes == size)
                for at in np.array_split(own, len(own) // 1024 + 1):
                    near = np.array([np.frombuffer(vectors[i], "<f8") for i in at]) @ fitted.T
                    near = np.maximum.reduceat(near, starts, axis=1)
                    if radii is not None:
                        met = near >= radii[first : first + near.shape[1]]
                        for i, row in zip(at.tolist(), met):
                            cells[i] = (np.flatnonzero(row) + first).tolist()
                        continue
                    many = min(probes, near.shape[1])
                    best = np.argsort(-near, axis=1, kind="stable")[:, :many]
                    value = np.take_along_axis(near, best, axis=1)
                    close = value >= value[:, :1] - reach
                    for i, row, fits in zip(at.tolist(), best, close):
                        cells[i] = (np.sort(row[fits]) + first).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "cells"],
            )

    placed = written(
        classes.select("digest", "copies", "vector", "size").mapInArrow(
            assign, "digest binary, copies long, vector binary, size int, cells array<int>"
        ),
        "placed-vectors",
    )
    members = placed.select("*", F.explode("cells").alias("cell"))
    sizes = (
        members.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("cell", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("blocks"))
    )
    keys = ["cell", "lo", "hi"]
    # As many rows as there are cells, MOST_CELLS per vector size.
    tiles = (
        tiled(members.join(F.broadcast(sizes), "cell"), "digest", F.col("blocks"))
        .select(*keys, "block", "digest", "copies", "vector", "cells")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )
    schema = "digest binary, n_links long, root binary"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, lo, hi), tile in groups(batches, keys):
            names = tile.column("digest").to_pylist()
            copies = np.array(tile.column("copies").to_pylist(), np.int64)
            block = np.array(tile.column("block").to_pylist())
            matrix = np.array([np.frombuffer(v, "<f8") for v in tile.column("vector").to_pylist()])
            cells = tile.column("cells").to_pylist()
            number: dict[int, int] = {}
            for own in cells:
                for c in own:
                    if c < cell:
                        number.setdefault(c, len(number))
            earlier = np.zeros((len(names), max(1, len(number))), np.float32)
            for i, own in enumerate(cells):
                earlier[i, [number[c] for c in own if c < cell]] = 1
            linked, root = np.zeros(len(names), np.int64), Forest(len(names))
            for start in range(0, len(names), 256):
                rows = slice(start, start + 256)
                good = matrix[rows] @ matrix.T >= similarity
                good &= earlier[rows] @ earlier.T == 0
                if lo != hi:
                    good &= block[rows, None] != block
                good &= np.arange(len(names)) > np.arange(len(names))[rows, None]
                linked[rows] += good @ copies
                linked += copies[rows] @ good
                for i in np.flatnonzero(good.any(axis=1)).tolist():
                    root.join(start + i, np.flatnonzero(good[i]))
            rows = np.flatnonzero(linked).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in rows], pa.binary()),
                    pa.array(linked[rows], pa.int64()),
                    pa.array([names[root.find(i)] for i in rows], pa.binary()),
                ],
                names=["digest", "n_links", "root"],
            )

    return tiles.mapInArrow(compare, schema)
