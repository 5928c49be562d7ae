"""Registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import shared_folder, written
from docengine.llm.cuckoo_dedup import exact_duplicates
from docengine.llm.embedding_dedup import linked_vectors
from docengine.llm.langid import held_out, learn, predict
from docengine.llm.lexical_search import index_documents, search
from docengine.llm.mixing import mix, shuffle_key
from docengine.llm.ngram_join import linked_documents
from docengine.llm.packing import pack
from docengine.llm.periodic_runs import periodic_runs
from docengine.llm.secret_scan import SECRET_SQL, base_spans, new_ledger, scan_history, spelled
from docengine.llm.token_counts import empty_cache, token_counts
from docengine.llm.token_output import read_token_files, write_token_files
from docengine.llm.topk import top_k
from docengine.llm.warc import checked_revisits, choose_records, read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path(BYTE_BPE)
    return token_counts(table(spark, folder, "documents"), tokenizer, empty_cache(spark))


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "archives")
    write_archives(choose_records(table(spark, folder, "pages")), archives)
    records = written(read_archives(spark, archives, payloads=False), "records")
    return checked_revisits(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "resolved"
    )


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = shared_folder(spark, "token-files")
    tokenizer = public_tokenizers.path(BYTE_BPE)
    write_token_files(table(spark, folder, "documents"), tokenizer, 2, files)
    return read_token_files(spark, files)


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("content")
    )
    found = scan_history(versions, new_ledger(spark))
    kinds = {kind: F.col("n_found")[kind] for kind in ("assign", "access", "hex")}
    return found.select(
        "doc_id",
        *[n.alias(f"n_{kind}") for kind, n in kinds.items()],
        F.sha2(spelled(base_spans(F.col("spans"))).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


ORACLE["op7_secret_scan"] = SECRET_SQL


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed_rows = mix(table(spark, folder, "documents"))
    # Where each draw stands in its shard: by these keys.
    keys = F.transform("shards", lambda shard, number: shuffle_key(shard, number))
    return mixed_rows.select(
        "doc_id", "size", "source_size", "target", "taken", "shards", keys.alias("shuffle_keys")
    )


@query
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked_documents(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "n_links", "component_id", "kept"
    )


@query
def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linked_vectors(table(spark, folder, "embeddings"))


@query
def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE["op3_top_k"] = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5"""


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out")
    )
    pieces = public_tokenizers.path(PIECE_BPE)
    model = learn(rows, ~F.col("held_out"), pieces)
    return predict(rows.drop("lang"), model, pieces).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """The contract's texts of op12: every tenth document continues periodically.

    Documents without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        word = lambda w, i: F.when(i < a, w).otherwise(words[a + (i - a) % p])
        return F.concat_ws(" ", F.transform(words, word))

    # A lambda variable holds the words, so that they are split once.
    split = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    changed = F.transform(
        split, lambda words: F.when(F.size(words) > 0, periodic(words)).otherwise("")
    )[0]
    return documents.withColumn("text", F.when(h % 10 == 0, changed).otherwise(F.col("text")))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic_runs(with_planted_periods(documents))
    runs = F.col("runs")
    # Runs are by start, then period, so the first of equal powers is the one to keep.
    best = F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))),
        runs[0],
        lambda most, run: F.when(
            run["length"] * most["period"] > most["length"] * run["period"], run
        ).otherwise(most),
    )
    lines = F.transform(
        runs, lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    )
    listed = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", F.when(F.size(runs) > 0, best)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Runs from pairs of equal five-word strings: every run has five words that come again one
# period on, and an island of such pairs at one distance is a run at that distance.
ORACLE["op12_periodic_runs"] = r"""
WITH source AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
               list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, CAST(3988292384 AS BIGINT)) ELSE d >> 1 END)),
             CAST(4294967295 AS BIGINT)) AS h
  FROM documents
), numbers AS (
  SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM source
), periods AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM numbers
), texts AS (
  SELECT row_no, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0
              THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])
              ELSE words END AS words
  FROM periods
), grams AS (
  SELECT row_no, i, words[i + 1:i + 5] AS gram
  FROM (SELECT row_no, words, unnest(range(n - 4)) AS i FROM texts WHERE n > 4)
), pairs AS (
  SELECT x.row_no, x.i, y.i - x.i AS q
  FROM grams x JOIN grams y ON x.row_no = y.row_no AND x.gram = y.gram AND x.i < y.i
), islands AS (
  SELECT row_no, q, i, i - row_number() OVER (PARTITION BY row_no, q ORDER BY i) AS island FROM pairs
), periodic AS (
  SELECT row_no, q, min(i) AS start, max(i) + 5 + q - min(i) AS length
  FROM islands GROUP BY row_no, q, island
), runs AS (
  SELECT row_no, start, length, min(q) AS period FROM periodic
  WHERE length >= greatest(6, 4 * q) GROUP BY row_no, start, length
), listed AS (
  SELECT row_no, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS spelled
  FROM runs GROUP BY row_no
), best AS (
  SELECT DISTINCT ON (row_no) row_no, start, length, period FROM runs
  ORDER BY row_no, CAST(length AS DOUBLE) / period DESC, start, period
), dropped AS (
  SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs
), placed AS (
  SELECT row_no, unnest(words) AS word, unnest(range(n)) AS i FROM texts
), kept AS (
  SELECT row_no, string_agg(word, ' ' ORDER BY i) AS body
  FROM placed ANTI JOIN dropped USING (row_no, i) GROUP BY row_no
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       (1000 * length) // period AS exponent_milli,
       sha256(coalesce(spelled, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (row_no) LEFT JOIN best USING (row_no) LEFT JOIN kept USING (row_no)"""


@query
def op13_cuckoo_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE["op13_cuckoo_dedup"] = r"""
WITH named AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM named
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)"""


@query
def op11_dual_tree_search(spark: SparkSession, folder: str) -> DataFrame:
    shards = index_documents(table(spark, folder, "documents"))
    return search(table(spark, folder, "benchmark"), shards, k=10)


ORACLE["op11_dual_tree_search"] = r"""
WITH documents_terms AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), totals AS (
  SELECT count(*) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM documents_terms WHERE len(terms) > 0
), item_terms AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), postings AS (
  SELECT row_no, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM documents_terms)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term
), parts AS (
  SELECT row_no, doc_id, term,
         w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part
  FROM postings JOIN weights USING (term), totals
), scores AS (
  SELECT item_id, row_no, doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM item_terms JOIN parts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
