"""A stream of documents to a feed of chunk changes, with keyed state.

The state of a document (kept in RocksDB, so it need not fit in memory) is the digests of
its chunks. A version of it that arrives is compared with them: only chunks that are new,
differ or are gone leave as change rows. Documents that come again unchanged leave none.

Documents are handled in groups by the hash of their owner: every call between Spark and
Python, every message to the state and every batch of results has a fixed cost, which a
document by itself would pay for each of its chunks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Counting the rows of a store would read each of them before it is written.
COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
# Groups of owners; the checkpoint of a stream holds for one number of them. A task has
# the rows of one group of a micro-batch in memory.
GROUPS = 4096
# Change rows that leave Python at a time.
ROWS_OUT = 10_000


class ChunkChanges(StatefulProcessor):
    """Per group of documents: rows (group, owner, version, uuid, content, digest) to change rows.

    A row whose uuid is null only says that the document came. Of several versions in
    one batch the highest counts. The state has one entry per document, its digests by uuid.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("documents", "owner string", "digests string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[str | None, tuple[int | None, list]] = {}
        for some in rows:
            for owner, version, *chunk in zip(*[some[c] for c in ("owner", "version", "uuid", "content", "digest")]):
                found = latest.get(owner)
                version = version if version == version else None  # NaN says null
                if found is None or version is not None and (found[0] is None or version > found[0]):
                    found = latest[owner] = version, []
                if version is not None and version == found[0]:
                    found[1].append(chunk)
        anything, out = self.held.exists(), []
        for owner, (_, chunks) in latest.items():
            out += self._changes(owner, chunks, anything)
            while len(out) >= ROWS_OUT:
                yield self._frame(out[:ROWS_OUT])
                out = out[ROWS_OUT:]
        yield self._frame(out)

    def _changes(self, owner: str | None, chunks: list, anything: bool) -> Iterator[tuple]:
        """The change rows of one document, whose state is brought up to date."""
        state = self.held.getValue((owner,)) if anything else None
        known = json.loads(state[0]) if state else {}
        now, gone = dict(known), set(known)
        for uuid, content, digest in chunks:
            if uuid is None or uuid != uuid:
                continue
            gone.discard(uuid)
            was = known.get(uuid)
            if was != digest:
                now[uuid] = digest
                yield uuid, content, "insert" if was is None else "update"
        for uuid in sorted(gone):
            del now[uuid]
            yield uuid, None, "delete"
        if now and now != known:
            self.held.updateValue((owner,), (json.dumps(now),))
        elif known and not now:
            self.held.removeKey((owner,))

    @staticmethod
    def _frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["uuid", "content", "_change_type"], dtype=object)

    def close(self) -> None:
        pass


def changes_stream(
    stream: DataFrame,
    chunks: Callable[[DataFrame], DataFrame],
    owner: str,
    version: str,
    target: str,
    checkpoint: str,
) -> StreamingQuery:
    """Write the chunk changes of every micro-batch to a folder of its own in ``target``.

    ``chunks`` turns the stream into rows of ``owner``, ``version``, ``uuid`` and ``content``,
    one with a null uuid for a document without chunks. A batch that is retried
    overwrites its folder, and a run goes on from the checkpoint and its state.
    """
    spark: SparkSession = stream.sparkSession
    digest = F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)
    rows = chunks(stream).select(
        F.col(owner).cast("string").alias("owner"),
        F.col(version).cast("long").alias("version"),
        "uuid",
        "content",
        digest.alias("digest"),
    )
    group = F.pmod(F.xxhash64("owner"), F.lit(GROUPS)).cast("int")
    changed = rows.withColumn("group", group).groupBy("group").transformWithStateInPandas(
        statefulProcessor=ChunkChanges(),
        outputStructType="uuid string, content string, _change_type string",
        outputMode="Update",
        timeMode="None",
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    settings = {PROVIDER: ROCKSDB, COUNTED: "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return (
            changed.writeStream.foreachBatch(write)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_changes(spark: SparkSession, target: str) -> DataFrame:
    """All change rows with the ``batch_id`` of their micro-batch."""
    return spark.read.schema("uuid string, content string, _change_type string, batch_id long").parquet(target)
