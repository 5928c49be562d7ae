"""What Python workers hold: the caches of one use, and few whole texts at a time."""

import gc
import weakref

import public_tokenizers
import pyarrow as pa

from docengine.llm.common import TEXT_ROWS, worker_state, written
from docengine.llm.langid import vocabulary
from docengine.llm.ngram_join import gram_set
from docengine.llm.tokenization import encoder

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_a_worker_keeps_the_caches_of_one_use():
    path = public_tokenizers.path("word_bpe_49k.json")
    gram_set("some words of a text")
    assert worker_state("words")["words"]
    made = encoder(path)
    made.ids("some words of a text")
    assert encoder(path) is made and made.cache  # kept from task to task
    kept = weakref.ref(made)
    del made
    gc.disable()  # nothing else may collect it
    try:
        vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
        assert kept() is None
    finally:
        gc.enable()
    assert not worker_state("words")
    assert encoder(path).ids("some words of a text") == encoder(path)._whole("some words of a text")


def test_whole_texts_come_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 4 * TEXT_ROWS + 1, 1, 1).selectExpr("CAST(id AS STRING) AS text")
    before = spark.conf.get(KEY)
    found = [r["n"] for r in written(rows.mapInArrow(sizes, "n long"), "sizes", of_texts=True).collect()]
    assert sum(found) == 4 * TEXT_ROWS + 1 and max(found) <= TEXT_ROWS
    assert spark.conf.get(KEY) == before
    spark.conf.set(KEY, "10")
    try:
        found = written(rows.mapInArrow(sizes, "n long"), "sizes", of_texts=True)
        assert max(r["n"] for r in found.collect()) <= 10
        assert spark.conf.get(KEY) == "10"
    finally:
        spark.conf.set(KEY, before)
