"""Exact deduplication over a stored index with cuckoo filters.

Texts are named by the SHA-256 of their normalised form and dealt over buckets. Every
bucket has a cuckoo filter of the live digests and its contents. A digest that the filter
does not know is new, without a look at any stored text; one that it knows is compared
with the bucket's stored content, text with text. Digests whose last document is deleted
leave the filter. A filter that overflows is built anew, twice as large, from the digests
that the bucket stores.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import join_by_hot_key, shared_folder, written

SLOTS = 4
MOST_KICKS = 500
LOAD = 0.8
# Digests for which a bucket is laid out: 8 KB of filter, 32 KB of digests.
KEYS_PER_BUCKET = 1024

MEMBERS = "row long, doc_id long, n_chars long, digest binary, bucket int, version int"
CONTENTS = "digest binary, bucket int, content string, status string, version int"
DELETED = "doc_id long, version int"
FILTERS = "bucket int, cells int, items long, cuckoo binary, version int"
LOG = "version int, buckets int"
STEP = "digest binary, status string, bucket int, cells int, items long, cuckoo binary"


class CuckooFilter:
    """16-bit fingerprints in cells of four slots; every digest has two cells.

    ``cells`` is a power of two. Of the 32 bytes of a digest the first eight choose the
    cell, the next two are the fingerprint (never 0, which marks a free slot).
    """

    def __init__(self, cells: int, table: bytes | None = None, items: int = 0):
        self.cells, self.items = cells, items
        self.slots = array("H", table if table is not None else bytes(2 * SLOTS * cells))

    @classmethod
    def for_items(cls, n: int) -> CuckooFilter:
        cells = 1
        while cells * SLOTS * LOAD < n:
            cells *= 2
        return cls(cells)

    @classmethod
    def of(cls, digests: list[bytes], cells: int = 1) -> CuckooFilter:
        """A filter that holds all the digests, of ``cells`` cells or as many more as it needs."""
        while True:
            made = cls(max(cells, cls.for_items(len(digests)).cells))
            if all(made.insert(*at) for at in made.places(digests)):
                return made
            cells = 2 * made.cells

    def table(self) -> bytes:
        return self.slots.tobytes()

    def places(self, digests: list[bytes]) -> list[tuple[int, int, int]]:
        """Fingerprint and both cells of every digest."""
        words = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)
        mask = np.uint64(self.cells - 1)
        fingerprint = words[:, 1] >> np.uint64(48)
        fingerprint[fingerprint == 0] = 1
        one = words[:, 0] & mask
        other = one ^ (self._step(fingerprint) & mask)
        return list(zip(fingerprint.tolist(), one.tolist(), other.tolist()))

    @staticmethod
    def _step(fingerprint):
        """What lies between the two cells of a fingerprint, before the mask."""
        return (fingerprint * 0x5BD1E995) >> 8

    def contains(self, fingerprint: int, one: int, other: int) -> bool:
        cell = self.slots[one * SLOTS : one * SLOTS + SLOTS]
        return fingerprint in cell or fingerprint in self.slots[other * SLOTS : other * SLOTS + SLOTS]

    def _put(self, fingerprint: int, cell: int) -> bool:
        for slot in range(cell * SLOTS, cell * SLOTS + SLOTS):
            if not self.slots[slot]:
                self.slots[slot] = fingerprint
                self.items += 1
                return True
        return False

    def insert(self, fingerprint: int, one: int, other: int) -> bool:
        """False on overflow: the filter has then lost a fingerprint and must be rebuilt."""
        if self._put(fingerprint, one) or self._put(fingerprint, other):
            return True
        cell = other
        for kick in range(MOST_KICKS):
            slot = cell * SLOTS + (kick * 7 + fingerprint) % SLOTS
            self.slots[slot], fingerprint = fingerprint, self.slots[slot]
            cell ^= self._step(fingerprint) & (self.cells - 1)
            if self._put(fingerprint, cell):
                return True
        return False

    def delete(self, fingerprint: int, one: int, other: int) -> bool:
        """Remove one copy of the fingerprint; only digests that were inserted may go."""
        for cell in (one, other):
            for slot in range(cell * SLOTS, cell * SLOTS + SLOTS):
                if self.slots[slot] == fingerprint:
                    self.slots[slot] = 0
                    self.items -= 1
                    return True
        return False


def _outcome(bucket: int, digests: list, statuses: list, made: CuckooFilter | None) -> pa.Table:
    """Digests with their statuses, and a row without digest that has the filter."""
    n, tail = len(digests), 1 if made else 0
    return pa.table(
        {
            "digest": pa.array([*digests, *[None] * tail], pa.binary()),
            "status": pa.array([*statuses, *["filter"] * tail], pa.string()),
            "bucket": pa.array([bucket] * (n + tail), pa.int32()),
            "cells": pa.array([*[None] * n, *([made.cells] if made else [])], pa.int32()),
            "items": pa.array([*[None] * n, *([made.items] if made else [])], pa.int64()),
            "cuckoo": pa.array([*[None] * n, *([made.table()] if made else [])], pa.binary()),
        }
    )


def _stored(states: pa.Table) -> CuckooFilter:
    if not states.num_rows:
        return CuckooFilter.for_items(KEYS_PER_BUCKET)
    state = states.slice(0, 1).to_pylist()[0]
    return CuckooFilter(state["cells"], state["cuckoo"], state["items"])


def _bucket_of(*tables: pa.Table) -> int:
    return next(t.column("bucket")[0].as_py() for t in tables if t.num_rows)


def _arrive(arrivals: pa.Table, states: pa.Table) -> pa.Table:
    """Which of a bucket's distinct arriving digests the filter knows; the others go in.

    A filter too small for all of them is sent on as ``full``, to be rebuilt.
    """
    bucket, held = _bucket_of(arrivals, states), _stored(states)
    digests = sorted(arrivals.column("digest").to_pylist())
    if not digests:
        return _outcome(bucket, [], [], held)
    places = held.places(digests)
    hits = [held.contains(*at) for at in places]
    statuses = ["hit" if hit else "new" for hit in hits]
    whole = all(held.insert(*at) for at, hit in zip(places, hits) if not hit)
    if whole:
        return _outcome(bucket, digests, statuses, held)
    return pa.concat_tables(
        [_outcome(bucket, digests, statuses, None), _outcome(bucket, [None], ["full"], None)]
    )


def _insert(arrivals: pa.Table, states: pa.Table) -> pa.Table:
    """Digests whose fingerprints were known but whose content was not go in, too."""
    bucket, held = _bucket_of(arrivals, states), _stored(states)
    digests = arrivals.column("digest").to_pylist()
    if all(held.insert(*at) for at in (held.places(digests) if digests else [])):
        return _outcome(bucket, [], [], held)
    return _outcome(bucket, [None], ["full"], None)


def _leave(dead: pa.Table, states: pa.Table) -> pa.Table:
    bucket, held = _bucket_of(dead, states), _stored(states)
    digests = dead.column("digest").to_pylist()
    for at in held.places(digests) if digests else []:
        if not held.delete(*at):
            raise ValueError(f"bucket {bucket}: a live digest is not in its filter")
    return _outcome(bucket, [], [], held)


def _rebuild(keys: pa.Table, states: pa.Table) -> pa.Table:
    """A filter of all the bucket's live digests, at least twice as large as the last."""
    digests = sorted(set(keys.column("digest").to_pylist()))
    made = CuckooFilter.of(digests, 2 * _stored(states).cells)
    return _outcome(_bucket_of(keys, states), [], [], made)


class CuckooIndex:
    """A deduplication index in a folder: members, contents, filters and a log of versions.

    Every change writes its own ``version=`` folders and is there once the log has it, so
    that a run that dies is repeated over what it left. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, version: int):
        self.spark, self.folder, self.buckets, self.version = spark, folder, buckets, version

    @classmethod
    def create(cls, spark: SparkSession, expected: int, folder: str | None = None) -> CuckooIndex:
        """An empty index with buckets for ``expected`` digests; it holds any number."""
        index = cls(spark, folder or shared_folder(spark, "dedup-index"), 1, 0)
        index.buckets = max(1, -(-expected // KEYS_PER_BUCKET))
        for name, schema in (
            ("members", MEMBERS), ("contents", CONTENTS), ("deleted", DELETED), ("filters", FILTERS),
        ):
            index._write(spark.createDataFrame([], schema).drop("version"), name, 0)
        index._commit(0)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CuckooIndex:
        last = spark.read.schema(LOG).parquet(f"{folder}/log").orderBy(F.col("version").desc()).first()
        return cls(spark, folder, last["buckets"], last["version"])

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")

    def _read(self, name: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows.filter(F.col("version") <= self.version)

    def _commit(self, version: int) -> None:
        row = self.spark.createDataFrame([(version, self.buckets)], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.version = version

    def _filters(self) -> DataFrame:
        """The filter of each bucket; every version writes all buckets that it changes."""
        rows = self._read("filters", FILTERS)
        last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
        return rows.join(last, ["bucket", "version"]).drop("version")

    def _step(self, digests: DataFrame, states: DataFrame, task) -> DataFrame:
        """Run ``task`` for every bucket over its digests and its filter."""
        rows = digests.select("digest", "bucket").groupBy("bucket")
        return rows.cogroup(states.groupBy("bucket")).applyInArrow(task, STEP)

    def _save_filters(self, steps: DataFrame, version: int, keys: DataFrame) -> None:
        """Store the filters that a step made, those that overflowed rebuilt from stored keys."""
        full = steps.filter(F.col("status") == "full").select("bucket")
        made = steps.filter(F.col("status") == "filter")
        if full.limit(1).count():
            rebuilt = self._step(
                keys.join(full, "bucket", "left_semi"),
                self._filters().join(full, "bucket", "left_semi"),
                _rebuild,
            )
            made = made.unionByName(rebuilt)
        self._write(made.select("bucket", "cells", "items", "cuckoo"), "filters", version)

    def live_members(self) -> DataFrame:
        """Rows of ``MEMBERS`` that no later version deleted."""
        gone = self._read("deleted", DELETED).groupBy("doc_id").agg(F.max("version").alias("until"))
        rows = self._read("members", MEMBERS)
        return rows.join(gone, "doc_id", "left").filter(
            F.col("until").isNull() | (F.col("until") < F.col("version"))
        ).drop("until")

    def live_digests(self) -> DataFrame:
        return self.live_members().groupBy("digest").agg(F.any_value("bucket").alias("bucket"))

    def insert(self, documents: DataFrame, normalised: Column) -> None:
        """Take in documents (``doc_id, text``); equal ``normalised`` texts are one digest."""
        version = self.version + 1
        content = F.coalesce(normalised, F.lit(""))
        digest = F.unhex(F.sha2(content.cast("binary"), 256))
        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")
        named = documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
            digest.alias("digest"),
            content.alias("content"),
        ).withColumn("bucket", bucket)
        before = self.live_digests()
        self._write(
            named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "digest", "bucket"),
            "members", version,
        )
        new_rows = self.spark.read.schema(MEMBERS).parquet(f"{self.folder}/members/version={version}")
        arrivals = new_rows.groupBy("digest").agg(F.any_value("bucket").alias("bucket"))
        steps = self._stepped(arrivals, self._filters(), _arrive, version)

        # One content per digest and task is shuffled, however many copies there are.
        contents = named.groupBy("digest").agg(
            F.any_value("content").alias("content"), F.any_value("bucket").alias("bucket")
        )
        known = steps.filter(F.col("digest").isNotNull()).select("digest", "status")
        hits = known.filter(F.col("status") == "hit").select("digest")
        stored = (
            self._read("contents", CONTENTS)
            .filter(F.col("content").isNotNull())
            .join(hits, "digest", "left_semi")
            .groupBy("digest")
            .agg(F.any_value("content").alias("stored"))
        )
        same = F.col("content") == F.col("stored")
        status = (
            F.when(F.col("status") == "new", "new")
            .when(F.col("stored").isNull(), "false hit")
            .when(same, "known")
            .otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
        )
        looked = (
            contents.join(known, "digest")
            .join(stored, "digest", "left")
            .withColumn("status", status)
            .select(
                "digest", "bucket",
                F.when(F.col("status") != "known", F.col("content")).alias("content"), "status",
            )
        )
        self._write(looked, "contents", version)
        missed = (
            self.spark.read.schema(CONTENTS)
            .parquet(f"{self.folder}/contents/version={version}")
            .filter(F.col("status") == "false hit")
        )
        if missed.limit(1).count():
            # Filters that this version leaves whole take them in as well; the others are
            # rebuilt with them.
            made = steps.filter(F.col("status") == "filter")
            wanted = missed.join(made.select("bucket"), "bucket", "left_semi")
            touched = wanted.select("bucket").distinct()
            again = self._step(wanted, made.join(touched, "bucket", "left_semi"), _insert)
            steps = (
                steps.filter(F.col("status") == "full")
                .unionByName(made.join(touched, "bucket", "left_anti"))
                .unionByName(again)
            )
        self._save_filters(steps, version, before.unionByName(arrivals))
        self._commit(version)

    def _stepped(self, digests: DataFrame, states: DataFrame, task, version: int) -> DataFrame:
        """A step, written, as what follows uses it several times."""
        folder = f"{self.folder}/steps/{version}"
        self._step(digests, states, task).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(STEP).parquet(folder)

    def delete(self, ids: DataFrame) -> None:
        """Take out all documents whose ``doc_id`` is among ``ids``; null names none.

        Digests without a live document leave their filters.
        """
        version = self.version + 1
        before = self.live_digests()
        gone = ids.select(F.col("doc_id").cast("long")).filter(F.col("doc_id").isNotNull()).distinct()
        self._write(gone, "deleted", version)
        left = self.live_members().join(
            self.spark.read.schema("doc_id long").parquet(f"{self.folder}/deleted/version={version}"),
            "doc_id", "left_anti",
        )
        after = left.groupBy("digest").agg(F.any_value("bucket").alias("bucket"))
        dead = before.join(after.select("digest"), "digest", "left_anti")
        touched = dead.select("bucket").distinct()
        states = self._filters().join(touched, "bucket", "left_semi")
        self._save_filters(self._stepped(dead, states, _leave, version), version, after)
        self._commit(version)

    def groups(self) -> DataFrame:
        """Live digests with ``group_size`` and the row that stays: ``keep_id`` and its place.

        That is the row with the most characters, then the smallest id (null last), then
        the row that was taken in first.
        """
        rank = F.struct(
            (-F.col("n_chars")).alias("fewest"), F.col("doc_id").isNull().alias("unnamed"),
            "doc_id", "version", "row",
        )
        best = self.live_members().groupBy("digest").agg(
            F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best")
        )
        return best.select(
            "digest", "group_size", F.col("best.doc_id").alias("keep_id"),
            F.col("best.version").alias("keep_version"), F.col("best.row").alias("keep_row"),
        )

    def decisions(self) -> DataFrame:
        """Every live row: ``doc_id, keep_id, group_size, kept, digest``.

        Rows of the few texts that very many rows share meet their group by a broadcast of
        at most 4,096 of them; the others by a shuffle in which no key is hot.
        """
        groups = written(self.groups(), "groups")
        kept = (F.col("version") == F.col("keep_version")) & (F.col("row") == F.col("keep_row"))
        members = self.live_members().select("doc_id", "digest", "version", "row")
        joined = join_by_hot_key(members, groups, "digest", "group_size")
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


# Every character of the class goes; texts that are then identical are equal.
BLANKS = r"[\x20\x09-\x0D]+"


def exact_duplicates(documents: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    Texts (null: empty) are equal when identical without blanks and U+0009 to U+000D. Of
    equal texts the one with the most code points before that stays, then the smallest
    doc_id (null last); of rows that repeat with both, exactly one. The documents enter a
    new index in ``batches`` insertions, dealt by a hash of their ids, so that copies that
    come later are found by the filters and verified. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    rows = documents.select("doc_id", "text")
    index = CuckooIndex.create(documents.sparkSession, rows.count())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for batch in range(batches):
        index.insert(rows.filter(part == batch), F.regexp_replace("text", BLANKS, ""))
    return index.decisions()
