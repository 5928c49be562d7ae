"""N-gram Jaccard join: documents whose sets of word n-grams are alike."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import left_join_by_hot_key, parts_of, strings, text_key, worker_state, written
from docengine.llm.graph import Forest, components, groups, tiled

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 128
TILE_ROWS = 1024
TILE_GRAMS = 2_000_000
KNOWN_WORDS = 500_000
PART_BYTES = 1 << 20  # texts that a task takes out of a batch at a time
CHUNK = 512
STEP = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(
    similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES
) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest wrong candidates, with
    which a pair at the threshold shares a band with the wanted probability and which
    ``most`` hash functions allow."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("more hash functions are needed for this recall")
    return best


def _hashed_words(text: str) -> np.ndarray:
    known = worker_state("words").setdefault("words", {})
    words = text.lower().split()
    if len(known) > KNOWN_WORDS:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_set(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased words between white
    space. A text of fewer words has one gram of all of them, one without words none."""
    words = _hashed_words(text)
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        grams = (grams ^ words[i : i + len(grams)]) * STEP
        grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash signature, folded to one 64-bit number per band."""
    random = np.random.default_rng(20240229)
    masks = random.integers(0, 1 << 63, bands * rows, np.uint64, endpoint=True)[:, None]
    odd = random.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), CHUNK):
        mixed = (grams[start : start + CHUNK] ^ masks) * odd
        np.minimum(least, mixed.min(axis=1), out=least)
    folded = np.full(bands, 1, np.uint64)
    for column in least.reshape(bands, rows).T:
        folded = (folded ^ column) * STEP
        folded ^= folded >> np.uint64(31)
    return folded.view(np.int64)


def linked_documents(
    documents: DataFrame,
    n: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: ``doc_id, text_key, class_id, n_links, component_id, kept``.

    Documents with equal gram sets form a class; ``class_id`` is its smallest id.
    Classes are joined: signatures of ``choose_bands`` meet by band hash, and the pairs
    that meet are verified on their full sets. ``n_links`` counts the other documents
    at the similarity or above, those of the own class included. ``component_id`` is
    the smallest id that links lead to, and ``kept`` says whether a row has it.

    Scale: only signatures are shuffled for all documents. Buckets with one class, and
    buckets that hold the same classes as one of an earlier band, go; texts move for
    the rest alone. Large buckets are cut into tiles, in which pairs are counted, not
    put out; a pair counts in the first band that it shares.

    Null texts and texts without words link with nothing and are kept; their class and
    component is their own id. A text shorter than n words links with its equals.
    Rows with a null id take part, and get a smallest id that is null only where no
    row of the component has one. Rows that repeat come back repeated. An empty table
    gives no rows. Other columns are ignored.
    """
    bands, rows = choose_bands(similarity, recall)
    named = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text"
    )
    schema = "doc_id long, text_key binary, digest binary, grams long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, PART_BYTES):
            digests, sizes, signed = [], [], []
            for text in strings(batch.column("text")):
                grams = gram_set(text, n)
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                signed.append(band_hashes(grams, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(signed, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "digest", "grams", "bands"],
            )

    signed = written(named.mapInArrow(sign, schema), "signatures", of_texts=True)
    classes = written(
        signed.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("class_id"),
            F.min(F.struct("doc_id", "text_key")).alias("shown"),
            F.any_value("grams").alias("grams"),
            F.any_value("bands").alias("bands"),
        ),
        "classes",
    )
    links = written(_links(named, classes, similarity, n), "links")
    edges = links.filter(F.col("digest") != F.col("root")).select("digest", "root")
    found = components(edges, "ngram").withColumnRenamed("node", "digest")
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
    table = classes.join(linked, "digest", "left").select(
        "digest",
        "copies",
        "class_id",
        (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("component").isNull(), F.col("class_id"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
        F.coalesce("component", "digest").alias("component"),
    )
    own = F.col("digest").isNull()
    # A class that very many rows hold meets them by a broadcast of few such classes.
    named = left_join_by_hot_key(
        signed.select("doc_id", "text_key", "digest"),
        written(table, "class-results"),
        "digest",
        "copies",
        F.xxhash64("doc_id", "text_key"),
    )
    return (
        named.select(
            "doc_id",
            "text_key",
            F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "component",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _links(named: DataFrame, classes: DataFrame, similarity: float, n: int) -> DataFrame:
    """Per tile and class: ``digest, n_links`` (documents of linked classes) and ``root``
    (a class of the tile that links lead to)."""
    members = classes.select(
        "digest", "grams", F.posexplode("bands").alias("band", "hash")
    )
    one = F.xxhash64("digest")
    buckets = (
        members.groupBy("band", "hash")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("grams").alias("grams"),
            F.sum(one.cast("decimal(20,0)")).alias("sum"),
            F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("xor"),
        )
        .filter(F.col("n") > 1)
        .groupBy("n", "grams", "sum", "xor")  # the same classes: the first band will do
        .agg(F.min(F.struct("band", "hash")).alias("bucket"))
    )
    blocks = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("grams") / TILE_GRAMS))
    chosen = buckets.select("bucket.band", "bucket.hash", blocks.cast("int").alias("blocks"))
    candidates = written(
        members.select("digest", "band", "hash").join(chosen, ["band", "hash"]), "candidates"
    )
    wanted = (
        candidates.select("digest")
        .distinct()
        .join(classes.select("digest", "shown", "copies", "bands"), "digest")
        .select(
            "digest", "copies", "bands",
            F.col("shown.doc_id").alias("_id"), F.col("shown.text_key").alias("_key"),
        )
    )
    # One text per class that has a candidate.
    texts = (
        named.join(
            wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
        )
        .groupBy("digest")
        .agg(
            F.any_value("copies").alias("copies"),
            F.any_value("bands").alias("bands"),
            F.any_value("text").alias("text"),
        )
    )
    texts = written(texts, "candidate-texts")
    keys = ["band", "hash", "lo", "hi"]
    tiles = (
        tiled(candidates, "digest", F.col("blocks"))
        .join(texts, "digest")
        .select(*keys, "block", "digest", "copies", "bands", "text")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )
    schema = "digest binary, n_links long, root binary"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, counts, roots = [], [], []
        for (band, _, lo, hi), tile in groups(batches, keys):
            names = tile.column("digest").to_pylist()
            sets = [gram_set(text, n) for text in tile.column("text").to_pylist()]
            linked, root = _linked(
                sets,
                np.array(tile.column("copies").to_pylist(), np.int64),
                np.array(tile.column("bands").to_pylist(), np.int64)[:, :band],
                np.array(tile.column("block").to_pylist()),
                lo != hi,
                similarity,
            )
            for i, name in enumerate(names):
                if linked[i]:
                    digests.append(name)
                    counts.append(int(linked[i]))
                    roots.append(names[root.find(i)])
            if len(digests) > 10_000:
                yield _batch(digests, counts, roots)
                digests, counts, roots = [], [], []
        yield _batch(digests, counts, roots)

    return tiles.mapInArrow(verify, schema)


def _batch(digests: list, counts: list, roots: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(roots, pa.binary())],
        names=["digest", "n_links", "root"],
    )


def _linked(sets, copies, earlier, block, across: bool, similarity: float):
    """Weights of the links of every row of a tile, and the forest that they make.

    Pairs that share an earlier band are left to it; a tile of two blocks holds the
    pairs between them.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    linked, root = np.zeros(m, np.int64), Forest(m)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    for i in range(m - 1):
        low = np.searchsorted(grams, sets[i], "left")
        many = np.searchsorted(grams, sets[i], "right") - low
        place = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
        shared = np.bincount(owner[place], minlength=m)
        union = sizes + sizes[i] - shared
        good = shared >= similarity * union - 1e-9
        good[: i + 1] = False
        if across:
            good &= block != block[i]
        others = np.flatnonzero(good)
        if len(others) and earlier.shape[1]:
            others = others[~(earlier[others] == earlier[i]).any(axis=1)]
        if len(others):
            linked[i] += copies[others].sum()
            linked[others] += copies[i]
            root.join(i, others)
    return linked, root


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """The documents with one row of each component: the one with its smallest id
    (null last; of rows with this id, the one with the smallest digest of the text; of
    equal rows, one). Texts without words all stay. The columns are those of the input."""
    light = written(
        linked_documents(documents, **options).select("doc_id", "text_key", "component"), "near"
    )
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    with_words = light.filter(F.col("component").isNotNull())
    first = with_words.groupBy("component").agg(
        F.min(at).alias("first"), F.count(F.lit(1)).alias("members")
    )
    distinct = with_words.groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    marked = (
        left_join_by_hot_key(
            distinct,
            written(first, "component-results"),
            "component",
            "members",
            F.xxhash64("doc_id", "text_key"),
        )
        .select(
            F.col("doc_id").alias("_id"),
            F.col("text_key").alias("_key"),
            (~at.eqNullSafe(F.col("first"))).alias("_gone"),
            (F.col("rows") > 1).alias("_repeated"),
        )
        .filter("_gone OR _repeated")
    )
    # The input's columns travel in one struct, so no name of theirs meets one of these.
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("own_id"),
        text_key(F.col("text")).alias("own_key"),
    )
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key"))
    once = F.row_number().over(Window.partitionBy("own_id", "own_key").orderBy(F.lit(1)))
    return (
        rows.join(marked, same, "left")
        .filter(~F.coalesce("_gone", F.lit(False)))
        .withColumn("nth", once)
        .filter((F.col("nth") == 1) | ~F.coalesce("_repeated", F.lit(False)))
        .select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
    )
