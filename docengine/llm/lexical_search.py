"""Ranked lexical search for many items at once: a dual-tree search.

Documents stand in shards, each a hierarchy of batches of similar documents; items stand in
blocks, each a hierarchy of similar items. The node of a document tree has, per term, the
largest part of a score that one of its documents gets from the term; the node of an item
tree has the union of its items' terms. Their product bounds every score between the two
nodes. Where it is below the weakest k-th score that the node's items have so far, no
document of the node can be among the k best of any of these items: both go at once.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import small_batches, written

SHARD_DOCUMENTS = 1024
SHARD_TERMS = 1 << 20
SHARDS_PER_GROUP = 16
ITEMS_PER_BLOCK = 512
BATCH = 32
ITEM_BATCH = 8
FAN = 8
# Blocks of items that are broadcast, so that shards stay where they lie: as many as a task
# holds, of up to so many bytes in all.
HELD_BLOCKS = 32
PASS_BYTES = 32 << 20
# Rows of a shard's payload that Python is given at a time: a row has a megabyte or more,
# which a batch holds in the JVM, outside its heap, and in the worker.
PAYLOAD_ROWS = 4

# A term is a longest stretch of other characters than these; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The same for the bytes of UTF-8: separators become blanks.
FOLD = bytes(
    ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(128)
) + bytes(range(128, 256))

SHARD_SCHEMA = "shard long, n_documents long, n_terms long, terms binary, postings binary"
FOUND_SCHEMA = "item_id long, doc_id long, score long, block int, item int"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def order_by_halves(owner: np.ndarray, term: np.ndarray, n: int, width: int) -> np.ndarray:
    """An order of ``n`` owners of terms in which similar ones are near each other.

    Every part is split by the term that is nearest to being in half of it, down to parts
    of about ``width``.
    """
    path = np.zeros(n, np.int64)
    spread = np.bincount(term)
    useful = np.flatnonzero((spread >= max(2, width // 4)) & (spread < n))
    number = np.full(len(spread), -1)
    number[useful] = np.arange(len(useful))
    chosen = number[term] >= 0 if len(term) else np.zeros(0, bool)
    owner, term = owner[chosen], number[term[chosen]]
    while len(useful) and n > width:
        parts, part = np.unique(path, return_inverse=True)
        if len(parts) * width >= n:
            break
        size = np.bincount(part)
        held = np.bincount(part[owner] * len(useful) + term, minlength=len(parts) * len(useful))
        held = held.reshape(len(parts), len(useful))
        best = np.abs(2 * held - size[:, None]).argmin(axis=1)
        has = np.zeros(n, bool)
        has[owner[term == best[part[owner]]]] = True
        before, path = path, 2 * path + has
        if len(np.unique(path)) == len(parts):
            path = before
            break
    return np.argsort(path, kind="stable")


def make_shard(ids: list, texts: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The terms of a shard with their document counts, and its postings.

    Documents are numbered in the order of the tree, postings are by term, then document.
    """
    sizes = np.array([len(words) for words in texts], np.int64)
    codes = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode()
    n, n_terms = len(texts), len(codes.dictionary)
    owner = np.repeat(np.arange(n), sizes)
    key, tf = np.unique(codes.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    term, owner = key // n, key % n
    order = order_by_halves(owner, term, n, BATCH)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    key = term * n + place[owner]
    by_key = np.argsort(key, kind="stable")
    df = np.bincount(term, minlength=n_terms)
    postings = {
        "ids": [ids[i] for i in order],
        "sizes": sizes[order],
        "start": np.append(0, np.cumsum(df)),
        "place": (key[by_key] % n).astype(np.min_scalar_type(n)),
        "tf": tf[by_key].astype(np.min_scalar_type(tf.max() if len(tf) else 0)),
    }
    return pickle.dumps((codes.dictionary, df)), pickle.dumps(postings)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's documents; documents without a term have no score."""
    task, number = TaskContext.get().partitionId(), 0

    def shard(ids: list, texts: list) -> pa.RecordBatch:
        terms, postings = make_shard(ids, texts)
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([task << 24 | number], pa.int64()),
                "n_documents": pa.array([len(ids)], pa.int64()),
                "n_terms": pa.array([sum(map(len, texts))], pa.int64()),
                "terms": pa.array([terms], pa.binary()),
                "postings": pa.array([postings], pa.binary()),
            }
        )

    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = terms_of(text.as_py())
            if not words:
                continue
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
            if len(ids) == SHARD_DOCUMENTS or held >= SHARD_TERMS:
                yield shard(ids, texts)
                number += 1
                ids, texts, held = [], [], 0
    if ids:
        yield shard(ids, texts)


def index_documents(documents: DataFrame) -> DataFrame:
    """The shards of all documents with terms, written: one scan, nothing is shuffled."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    # Snappy would take buffers of a whole page, here all shards of a file, outside the heap.
    return written(rows.mapInArrow(_index, SHARD_SCHEMA), "lexical-shards", codec="zstd")


def _item_block(key: tuple, table: pa.Table) -> pa.Table:
    """A block of items: their terms, and the tree over them."""
    terms = table.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
    term = terms.indices.to_numpy().astype(np.int64)
    items = table.column("item_id").combine_chunks()
    ids = sorted(set(items.to_pylist()), key=lambda i: (i is None, i or 0))
    number = {item: i for i, item in enumerate(ids)}
    owner = np.array([number[item] for item in items.to_pylist()], np.int64)
    order = order_by_halves(owner, term, len(ids), ITEM_BATCH)
    own = [np.unique(term[owner == i]) for i in order.tolist()]
    levels = [own]
    width = ITEM_BATCH
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append(
            [np.unique(np.concatenate(last[i : i + width])) for i in range(0, len(last), width)]
        )
        width = FAN
    payload = {"ids": [ids[i] for i in order.tolist()], "terms": terms.dictionary, "levels": levels}
    return pa.table(
        {
            "block": pa.array([key[0].as_py()], pa.int32()),
            "n_items": pa.array([len(ids)], pa.int32()),
            "items": pa.array([pickle.dumps(payload)], pa.binary()),
        }
    )


def item_blocks(items: DataFrame) -> DataFrame:
    """Blocks of items: ``block, n_items, items``. Rows of one item_id are one item."""
    term = F.explode(
        F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    )
    terms = written(
        items.select(F.col("item_id").cast("long").alias("item_id"), term.alias("term")).distinct(),
        "item-terms",
    )
    n = terms.select("item_id").distinct().count()
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n // ITEMS_PER_BLOCK)))).cast("int")
    return written(
        terms.withColumn("block", block)
        .groupBy("block")
        .applyInArrow(_item_block, "block int, n_items int, items binary"),
        "item-blocks",
    )


class Best:
    """The k best documents of an item so far; ``floor`` is a score that k others have."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.heap = k, floor, []

    def least(self) -> int:
        """Scores below it are out; 1 at least, as a score of 0 is none."""
        full = self.heap[0][0] if len(self.heap) == self.k else 0
        return max(1, self.floor, full)

    def take(self, score: int, doc_id: int | None) -> None:
        entry = score, doc_id is not None, -(doc_id or 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_shard(
    block: dict, weights: np.ndarray, best: list[Best], terms: bytes, postings: bytes,
    n_documents: int, n_terms: int,
) -> None:
    """Both trees of a block and a shard at once; ``best`` has the block's items' results."""
    known, _ = pickle.loads(terms)
    shard = pickle.loads(postings)
    at = pc.index_in(block["terms"], known.cast(pa.binary()))
    columns = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False) & (weights > 0))
    if not len(columns):
        return
    start = shard["start"]
    own = at.take(pa.array(columns)).to_numpy().astype(np.int64)
    counts = start[own + 1] - start[own]
    first = np.cumsum(counts) - counts
    entries = np.arange(counts.sum()) + np.repeat(start[own] - first, counts)
    column = np.repeat(columns, counts)
    place, tf = shard["place"][entries].astype(np.int64), shard["tf"][entries].astype(np.int64)
    # Integer arithmetic of the contract; all values are positive.
    m = 10 + (90 * shard["sizes"] * n_documents) // n_terms
    part = weights[column] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))

    # Coordinate maxima of the batches: entries are by term, then place.
    n_batches, width = -(-len(m) // BATCH), len(weights)
    cell = column * n_batches + place // BATCH
    edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    largest = np.zeros((n_batches, width), np.int64)
    largest[cell[edges] % n_batches, cell[edges] // n_batches] = np.maximum.reduceat(part, edges)
    maxima = [largest]
    while len(maxima[-1]) > 1:
        maxima.append(np.maximum.reduceat(maxima[-1], np.arange(0, len(maxima[-1]), FAN), axis=0))
    by_place = np.argsort(place, kind="stable")
    place, column, part = place[by_place], column[by_place], part[by_place]
    batch_start = np.searchsorted(place, np.arange(n_batches + 1) * BATCH)
    levels, ids = block["levels"], shard["ids"]
    seat = np.full(width, -1)

    def children(level: int, i: int) -> range:
        width = ITEM_BATCH if level == 1 else FAN
        return range(i * width, min((i + 1) * width, len(levels[level - 1])))

    def below(level: int, nodes: np.ndarray) -> np.ndarray:
        found = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return found[found < len(maxima[level - 1])]

    def weakest(level: int, i: int) -> int:
        """The lowest score that can still enter the k best of one of the node's items."""
        if level == 0:
            return best[i].least()
        if level == 1:
            return min(best[item].least() for item in children(1, i))
        return min(weakest(level - 1, child) for child in children(level, i))

    def score(batch: int, item_node: int) -> None:
        """Exact scores of a batch for a batch of items."""
        union = levels[1][item_node] if len(levels) > 1 else levels[0][0]
        seat[union] = np.arange(len(union))
        a, b = batch_start[batch], batch_start[batch + 1]
        seats = seat[column[a:b]]
        inside = seats >= 0
        size = min(BATCH, len(ids) - batch * BATCH)
        table = np.zeros((size, len(union)), np.int64)
        table[place[a:b][inside] - batch * BATCH, seats[inside]] = part[a:b][inside]
        for item in children(1, item_node) if len(levels) > 1 else (0,):
            scores = table[:, seat[levels[0][item]]].sum(axis=1)
            for i in np.flatnonzero(scores >= best[item].least()).tolist():
                best[item].take(int(scores[i]), ids[batch * BATCH + i])
        seat[union] = -1

    def visit(item_level: int, item_node: int, level: int, nodes: np.ndarray) -> None:
        """Go down both trees, one level of each in turn, the largest bounds first."""
        bounds = maxima[level][np.ix_(nodes, levels[item_level][item_node])].sum(axis=1)
        hopeful = bounds >= weakest(item_level, item_node)
        nodes, bounds = nodes[hopeful], bounds[hopeful]
        if not len(nodes):
            return
        order = np.argsort(-bounds, kind="stable")
        nodes, bounds = nodes[order], bounds[order]
        lowest = min(1, len(levels) - 1)
        if item_level > lowest:
            for child in children(item_level, item_node):
                visit(item_level - 1, child, max(level - 1, 0), below(level, nodes) if level else nodes)
        elif level:
            visit(item_level, item_node, level - 1, below(level, nodes))
        else:
            for batch, bound in zip(nodes.tolist(), bounds.tolist()):
                if bound < weakest(item_level, item_node):
                    break
                score(batch, item_node)

    visit(len(levels) - 1, 0, len(maxima) - 1, np.arange(len(maxima[-1])))


def _searcher(k: int, n_documents: int, n_terms: int):
    """Task code: carries every block's best from shard to shard."""

    def results(state: dict) -> Iterator[pa.RecordBatch]:
        for number, (block, _, best) in state.items():
            rows = [
                (block["ids"][item], -negative if named else None, score, number, item)
                for item, found in enumerate(best)
                for score, named, negative in found.heap
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["item_id", "doc_id", "score", "block", "item"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("block")[i].as_py()
                if number not in state:
                    if len(state) == HELD_BLOCKS:
                        yield from results(state)
                        state = {}
                    block = pickle.loads(batch.column("items")[i].as_py())
                    weights = np.array(batch.column("weights")[i].as_py(), np.int64)
                    floors = batch.column("floors")[i].as_py() or [0] * len(block["ids"])
                    state[number] = block, weights, [Best(k, floor) for floor in floors]
                block, weights, best = state[number]
                terms, postings = (batch.column(c)[i].as_py() for c in ("terms", "postings"))
                search_shard(block, weights, best, terms, postings, n_documents, n_terms)
        yield from results(state)

    return search


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents the terms of every block are."""
    state: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column("block")[i].as_py()
            if number not in state:
                asked = pickle.loads(batch.column("items")[i].as_py())["terms"]
                state[number] = asked, np.zeros(len(asked), np.int64)
            asked, counts = state[number]
            known, df = pickle.loads(batch.column("terms")[i].as_py())
            at = pc.index_in(asked, known.cast(pa.binary()))
            valid = at.is_valid().to_numpy(zero_copy_only=False)
            counts[valid] += df[at.drop_null().to_numpy()]
    for number, (_, counts) in state.items():
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([number] * len(counts), pa.int32()),
                "term": pa.array(np.arange(len(counts)), pa.int32()),
                "df": pa.array(counts, pa.int64()),
            }
        )


def search(items: DataFrame, shards: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of every item: ``item_id, rank, doc_id, score``.

    ``shards`` are those of ``index_documents``, ``items`` has ``item_id, text`` and any other
    columns. Score: integers as the contract of ``op11`` states them. Equal scores are by
    ascending doc_id, documents without an id last; rows that repeat rank each. Only scores
    above 0 count, so items without a term, or whose terms no document has, have no rows;
    null texts have no terms. Rows with the same item_id are one item, with the terms of
    all of them; so are those without one.

    Blocks of items meet groups of shards in tasks, by an equality join; few blocks are
    broadcast, and all shards are one group. Each block first searches one shard; the k-th
    scores found there go with it to all the others.
    """
    spark = shards.sparkSession
    totals = shards.agg(
        F.sum("n_documents").alias("n"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("shards")
    ).first()
    n, homes_apart = totals["n"] or 0, max(1, -(-totals["shards"] // SHARDS_PER_GROUP))
    blocks = item_blocks(items)
    held = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("items")).alias("bytes")).first()
    few = held["n"] <= HELD_BLOCKS and (held["bytes"] or 0) <= PASS_BYTES
    near = F.broadcast if few else lambda rows: rows
    groups = 1 if few else homes_apart
    group = lambda number, parts: F.pmod(number, F.lit(parts)).cast("int")
    shards = shards.withColumn("part", group(F.xxhash64("shard"), groups))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    counts = (
        near(blocks.select("block", "items", everywhere.alias("part")))
        .join(shards.select("part", "terms"), "part")
        .select("block", "items", "terms")
        .mapInArrow(_document_counts, "block int, term int, df long")
    )
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1)))
    weights = (
        counts.groupBy("block", "term")
        .agg(F.sum("df").alias("df"))
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight")))).alias("listed"))
        .select("block", F.col("listed.weight").alias("weights"))
    )
    with small_batches(spark, PAYLOAD_ROWS):
        weighted = written(blocks.join(weights, "block"), "weighted-items")
    task = _searcher(k, n, totals["terms"] or 0)

    # One shard for each block comes first, unless the block's group has none.
    first = shards.groupBy(group(F.xxhash64("shard"), homes_apart).alias("own")).agg(F.min("shard").alias("home"))
    homes = weighted.withColumn("own", group(F.col("block"), homes_apart)).join(first, "own", "left").drop("own")
    # Only the shards that come first are moved to their blocks.
    leading = shards.drop("part").join(F.broadcast(first.select(F.col("home").alias("shard"))), "shard", "left_semi")
    with small_batches(spark, PAYLOAD_ROWS):
        at_home = written(
            near(homes).join(leading, F.col("home") == F.col("shard"))
            .select("block", "items", "weights", F.lit(None).cast("array<long>").alias("floors"), "terms", "postings")
            .mapInArrow(task, FOUND_SCHEMA),
            "first-shard-results",
        )
    floors = (
        at_home.groupBy("block", "item")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
        .groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("item", "floor"))).alias("known"))
    )
    number = F.sequence(F.lit(0), F.col("n_items") - 1)
    known = F.transform(number, lambda i: F.coalesce(F.col("known")[i], F.lit(0)).cast("long"))
    asked = homes.join(floors, "block", "left").select(
        "block", "items", "weights", known.alias("floors"), "home", everywhere.alias("part")
    )
    with small_batches(spark, PAYLOAD_ROWS):
        rest = written(
            near(asked).join(shards, "part")
            .filter(F.col("home").isNull() | (F.col("shard") != F.col("home")))
            .select("block", "items", "weights", "floors", "terms", "postings")
            .mapInArrow(task, FOUND_SCHEMA),
            "other-shard-results",
        )
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.asc_nulls_last("doc_id"))
    return (
        at_home.unionByName(rest)
        .select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score")
        .filter(F.col("rank") <= k)
    )
