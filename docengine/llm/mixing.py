"""Mixing sources to target weights.

Targets are shared out by weight, bounded by a number of passes over the source.
A source's documents, ordered by a seeded hash, are cut into blocks; its target is
an exact quota of block draws. A splitting tree divides the quotas of all sources
among the output shards by multivariate hypergeometric draws, so each shard's mix is
what sampling without replacement would give. A shard then owns disjoint ranges of
every source's permuted block sequence and orders its documents by another hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import fresh, running_before, written

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
SEED = 17
CYCLE = (5.0, 2.0, 1.0)
BLOCK_WORDS = 20_000
MOST_BLOCKS = 4096  # per source; blocks of a larger source are larger
SHARD_WORDS = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_out(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Targets that add up to the sum of the sizes, in proportion to the weights;
    none above ``most`` times its source, the excess reshared until none is."""
    left = float(sum(sizes))
    targets = [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0]
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = most * float(sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int):
    """(first draws, numbers of draws) of a shard, one of each per source.

    Walks down from the root: a node with k shards gives its left child k // 2 of
    them and a share of its draws that is as many of its draws as belong to these
    shards, taken without replacement. Every node draws from its own seed, so any
    task finds the same numbers without asking another.
    """
    first, quotas = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(quotas.sum())
        taken = total * (middle - low) // (high - low)
        random = np.random.default_rng([seed, low, high])
        left = _hypergeometric(random, quotas, taken)
        if shard < middle:
            quotas, high = left, middle
        else:
            first, quotas, low = first + left, quotas - left, middle
    return first, quotas


def _hypergeometric(random: np.random.Generator, colors: np.ndarray, taken: int) -> np.ndarray:
    """Source by source: how many of ``taken`` draws without replacement are of each."""
    out, rest = np.zeros_like(colors), int(colors.sum())
    for i, good in enumerate(colors.tolist()):
        rest -= good
        if taken and good:
            got = _draw(random, good, rest, taken)
            out[i] = got
            taken -= got
    return out


# numpy draws from populations below this size.
LIMIT = 1_000_000_000


def _draw(random: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """One hypergeometric number, of the same law at every size: numpy's below its limit,
    beyond it by inversion."""
    if not taken or not good:
        return 0
    if not bad:
        return taken
    if good + bad < LIMIT:
        return int(random.hypergeometric(good, bad, taken))
    # Probabilities relative to that of the mode, by the ratios of neighbours, as far as
    # twelve standard deviations: what lies beyond is below the precision of doubles.
    n = good + bad
    low, high = max(0, taken - bad), min(good, taken)
    mode = min(max((taken + 1) * (good + 1) // (n + 2), low), high)
    width = 50 + int(12 * (taken * (good / n) * (bad / n) * ((n - taken) / (n - 1))) ** 0.5)
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)
    rising = np.cumprod((good - up) / (up + 1) * ((taken - up) / (bad - taken + up + 1)))
    falling = np.cumprod(down / (good - down + 1) * ((bad - taken + down) / (taken - down + 1)))
    chances = np.concatenate([falling[::-1], [1.0], rising]).cumsum()
    return mode - len(falling) + int(np.searchsorted(chances, random.random() * chances[-1], "right"))


def _place(seed: int, *values: Column) -> Column:
    """A number in [0, 1) from a row's own values."""
    return F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(
    totals: DataFrame, weights: dict[str, float] | None = None, most: float = MOST_PASSES
) -> pd.DataFrame:
    """One row per source, by code point, null last. The table of sources is small
    next to the data (one row each) and is the only thing the driver sees."""
    rows = totals.select("source", "size").toPandas()
    rows["_null"] = rows["source"].isna()
    rows = rows.sort_values(["_null", "source"], kind="stable").reset_index(drop=True)
    if weights is None:
        rows["weight"] = [CYCLE[i % len(CYCLE)] for i in range(len(rows))]
    else:
        rows["weight"] = [float(weights.get(source, 0.0)) for source in rows["source"]]
    rows["target"] = share_out(rows["size"].tolist(), rows["weight"].tolist(), most)
    rows["source_no"] = range(len(rows))
    return rows.drop(columns="_null")


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    most: int = MOST_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """How often each document is drawn, and into which shards.

    Rows of ``documents`` come back with ``size`` (words; null text: 0),
    ``source_size``, ``target`` (of the source), ``shards`` (the shard of each draw,
    at most ``most`` of them) and ``taken`` (size times draws). Without weights,
    sources by code point, null last, weigh 5, 2, 1, repeating. A null source is a
    source of its own. Rows are drawn by hashes of doc_id, source and text: reruns
    agree, and rows that repeat in every column are drawn alike. A source without
    words has target 0 and its rows are not drawn. An empty table gives no rows.
    Columns named like the result's are replaced.

    Whole blocks are drawn until the target is reached; of the block that crosses it,
    documents in hash order as long as they bring the sum nearer to the target, so a
    source misses it by less than one document.
    """
    spark = documents.sparkSession
    own = ("size", "source_size", "target", "shards", "taken")
    kept = [c for c in documents.columns if c not in own]
    size = word_count(F.col("text"))
    at = _place(seed, F.col("doc_id"), F.col("source"), F.col("text"))
    light = written(
        documents.select(
            "doc_id", "source", _hash("text").alias("text_hash"), size.alias("size"), at.alias("at")
        ),
        "sizes",
    )
    totals = light.groupBy("source").agg(F.sum("size").alias("size"))
    plan = source_targets(totals, weights, most)
    if plan.empty:
        return documents.select(
            *kept, *[F.lit(None).cast(t).alias(c) for c, t in zip(own, KINDS)]
        ).limit(0)
    block_count = [
        min(MOST_BLOCKS, max(1, -(-int(n) // BLOCK_WORDS))) for n in plan["size"].tolist()
    ]
    sources = spark.createDataFrame(
        [
            (row.source if isinstance(row.source, str) else None, int(row.source_no),
             int(row.size_), float(row.target), blocks)
            for row, blocks in zip(plan.rename(columns={"size": "size_"}).itertuples(), block_count)
        ],
        "source string, source_no int, source_size long, target double, blocks int",
    )
    by_source = light.join(
        sources, light["source"].eqNullSafe(sources["source"]), "inner"
    ).select(
        light["*"], "source_no", "source_size", "target", "blocks",
        F.floor(F.col("at") * F.col("blocks")).cast("int").alias("block"),
    )
    placed = written(by_source, "placed")
    blocks = placed.groupBy("source_no", "block", "blocks", "source_size", "target").agg(
        F.sum("size").alias("words")
    )
    draws, partial = _draws(blocks, plan, seed)
    cut = _cut(placed, partial)
    drawn = (
        placed.join(draws, ["source_no", "block"], "left")
        .join(cut, ["source_no", "block"], "left")
        .withColumn(
            "shards",
            F.concat(
                F.coalesce("shards", F.array().cast("array<int>")),
                F.when(
                    (F.col("at") < F.col("cut_at")) | (F.col("at") == F.col("one_at")),
                    F.array("cut_shard"),
                ).otherwise(F.array().cast("array<int>")),
            ),
        )
    )
    keys = ("doc_id", "source", "text_hash")
    # No input has a column of these names.
    left, right = {c: fresh(c) for c in keys}, {c: fresh(c) for c in keys}
    result = drawn.select(
        *[F.col(c).alias(right[c]) for c in keys],
        "size", "source_size", "target", "shards",
        (F.col("size") * F.size("shards")).alias("taken"),
    ).dropDuplicates([right[c] for c in keys])
    same = [F.col(left[c]).eqNullSafe(F.col(right[c])) for c in keys]
    rows = documents.select(
        *kept,
        F.col("doc_id").alias(left["doc_id"]),
        F.col("source").alias(left["source"]),
        _hash("text").alias(left["text_hash"]),
    )
    return rows.join(result, same, "inner").select(*kept, *own)


def _hash(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.xxhash64(name))


KINDS = ("long", "long", "double", "array<int>", "long")


def _draws(blocks: DataFrame, plan: pd.DataFrame, seed: int):
    """Whole draws of every block, with their shards, and the blocks drawn in part.

    The permuted sequence of a source is its blocks in hash order of (source, block),
    once per pass. A source has ``MOST_BLOCKS`` blocks at most, so the windows over
    its blocks are bounded.
    """
    spark = blocks.sparkSession
    ordered = blocks.withColumn("key", F.xxhash64(F.lit(seed), "source_no", "block"))
    ordered = running_before(ordered, "words", "words_before", ["source_no"], ["key", "block"])
    window = Window.partitionBy("source_no").orderBy("key", "block")
    ordered = ordered.withColumn("turn", F.row_number().over(window) - 1)
    ordered = ordered.withColumn(
        "there", F.count(F.lit(1)).over(Window.partitionBy("source_no"))
    )
    size, target = F.col("source_size"), F.col("target")
    # Passes over the whole source, and what is left for the last one.
    passes = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("int")
    rest = F.when(size > 0, target - passes * size).otherwise(F.lit(0.0))
    ordered = written(
        ordered.withColumn("passes", passes)
        .withColumn("rest", rest)
        .withColumn("whole", F.col("words_before") + F.col("words") <= F.col("rest"))
        .withColumn("part", ~F.col("whole") & (F.col("words_before") < F.col("rest"))),
        "blocks",
    )
    quotas = ordered.groupBy("source_no").agg(
        F.sum(F.col("passes") + (F.col("whole") | F.col("part")).cast("int")).alias("draws")
    )
    counted = {row["source_no"]: row["draws"] for row in quotas.collect()}
    vector = np.array([counted.get(i, 0) for i in range(len(plan))], np.int64)
    shards = max(1, int(-(-int(plan["target"].sum()) // SHARD_WORDS)))
    quota = spark.sparkContext.broadcast(vector)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                first, many = split_quotas(quota.value, shards, shard, seed)
                used = np.flatnonzero(many)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array(first[used], pa.int64()),
                        pa.array(first[used] + many[used], pa.int64()),
                        pa.array(np.full(len(used), shard), pa.int32()),
                    ],
                    names=["source_no", "from_draw", "to_draw", "shard"],
                )

    # A draw's number runs through the passes of its source; a shard owns a range.
    ranges = spark.range(0, shards).mapInArrow(
        walk, "source_no int, from_draw long, to_draw long, shard int"
    )
    turns = ordered.withColumn(
        "pass", F.explode(F.sequence(F.lit(0), F.col("passes")))
    ).filter((F.col("pass") < F.col("passes")) | F.col("whole") | F.col("part"))
    turns = turns.withColumn("draw", F.col("pass").cast("long") * F.col("there") + F.col("turn"))
    numbered = written(
        ranges.select(
            "source_no", "shard", F.explode(F.sequence("from_draw", F.col("to_draw") - 1)).alias("draw")
        ),
        "shard-draws",
    )
    owned = written(turns.join(numbered, ["source_no", "draw"], "left"), "turns")
    last = F.col("pass") == F.col("passes")
    draws = (
        owned.filter(~last | F.col("whole"))
        .groupBy("source_no", "block")
        .agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    )
    partial = owned.filter(last & F.col("part")).select(
        "source_no", "block", (F.col("rest") - F.col("words_before")).alias("wanted"),
        F.col("shard").alias("cut_shard"),
    )
    return draws, partial


def _cut(placed: DataFrame, partial: DataFrame) -> DataFrame:
    """Up to which place the one block per source is taken that crosses the target."""
    inside = (
        placed.join(F.broadcast(partial), ["source_no", "block"])
        .groupBy("source_no", "block", "wanted", "cut_shard", "at")
        .agg(F.sum("size").alias("size"))
    )
    inside = running_before(inside, "size", "before", ["source_no", "block"], ["at"])
    fits = F.col("before") + F.col("size") <= F.col("wanted")
    key = ["source_no", "block", "cut_shard"]
    cut = inside.groupBy(*key).agg(
        F.coalesce(F.min(F.when(~fits, F.col("at"))), F.lit(2.0)).alias("cut_at")
    )
    # What is then missing comes from the one document beyond it that fits it best.
    beyond = inside.join(F.broadcast(cut), key)
    missing = F.col("wanted") - F.sum(
        F.when(F.col("at") < F.col("cut_at"), F.col("size")).otherwise(0)
    ).over(Window.partitionBy(*key))
    off = F.abs(F.col("missing") - F.col("size"))
    better = (F.col("at") >= F.col("cut_at")) & (off < F.col("missing"))
    return (
        beyond.withColumn("missing", missing)
        .groupBy(*key, "cut_at")
        .agg(F.min_by("at", F.when(better, F.struct(off, F.col("at")))).alias("one_at"))
        .withColumn("one_at", F.coalesce("one_at", F.lit(-1.0)))
    )


def shuffle_key(shard: str | Column, number: str | Column, seed: int = SEED) -> Column:
    """A shard orders its draws by this; ``number`` is the draw's place among those of
    its document (in ``shards``)."""
    return F.xxhash64(F.lit(seed + 1), shard, number, "doc_id", "text")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each document once per draw, with its shard, locally
    shuffled. Only for writing; the order lives in the files. Columns named ``_pass``,
    ``_shard`` or ``_order`` are replaced."""
    documents = documents.drop("_pass", "_shard", "_order")
    drawn = mix(documents, **options)
    rows = drawn.select(
        *[c for c in documents.columns if c in drawn.columns],
        F.posexplode("shards").alias("_pass", "_shard"),
    )
    order = shuffle_key("_shard", "_pass", options.get("seed", SEED))
    return (
        rows.withColumn("_order", order)
        .repartition("_shard")
        .sortWithinPartitions("_shard", "_order")
    )
