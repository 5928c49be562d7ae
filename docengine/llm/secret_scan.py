"""Secret scans over every version of every path, kept in a ledger of blobs.

DataFrame functions only. A version's content is named by its SHA-256; the ledger
says which (blob, rule version) pairs have been scanned and what was found in them.
A run applies to each distinct blob the rules whose pair with it is not there yet, appends
what it finds, and joins the findings back to all paths that ever held the blob.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import shared_folder

SPAN = "struct<start:long,rank:int,kind:string,end:long>"
LEDGER_SCHEMA = f"blob binary, rules array<string>, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, of which those stay whose
    ``group`` has at least ``least`` characters. ``hint`` is a cheap pattern without
    which there is no match."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


# Fixed values of the base rules, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign", 1,
        r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2, 6, r"(?i)password|passwd|secret|token|api_?key",
    ),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
# What the method adds: forms of keys that name themselves.
ADDED = (
    # To the END line; without one, as far as lines of base64 go.
    Rule(
        "pem", 2,
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:[A-Za-z0-9+/=:,\x20\x09-\x0D-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\x09-\x0D]*)",
        0, 1, "PRIVATE KEY-----",
    ),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]+:([^\x00-\x20/:@]+)@", 1, 3, "://[^\\x00-\\x20/:@]+:"),
)
RULES = BASE + ADDED


def rule_version(rule: Rule) -> str:
    """Names a rule as it is: any change of its number, pattern or limits is a new version."""
    made = hashlib.sha256(repr((rule.pattern, rule.group, rule.least, rule.hint)).encode())
    return f"{rule.kind}.{rule.version}.{made.hexdigest()[:12]}"


def new_ledger(spark: SparkSession) -> str:
    """A new ledger folder below the shared folder, in which nothing has been scanned."""
    folder = shared_folder(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER_SCHEMA).write.parquet(folder)
    return folder


def _rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points, end exclusive.

    The parts between the matches, as ``split`` gives them, and the matches
    themselves add up to the places. Only one of the places of a text is kept per
    match, and texts without the hint are not looked at again.
    """
    parts = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = found if not rule.group else F.regexp_extract_all(
        text, F.lit(rule.pattern), F.lit(rule.group)
    )
    each = F.arrays_zip(
        F.transform(parts, lambda part: F.length(part).cast("long")).alias("gap"),
        F.transform(found, lambda match: F.length(match).cast("long")).alias("long"),
        F.transform(inner, lambda match: F.length(match).cast("long")).alias("inner"),
    )
    empty = F.lit([]).cast(f"array<{SPAN}>")
    state = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(done: Column, item: Column) -> Column:
        start = done["at"] + item["gap"]
        end = start + item["long"]
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
            end.alias("end"),
        )
        keep = item["inner"] >= rule.least
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(keep, F.concat(done["spans"], F.array(span).cast(f"array<{SPAN}>")))
            .otherwise(done["spans"])
            .alias("spans"),
        )

    spans = F.aggregate(each, state, step, lambda done: done["spans"])
    return F.when(text.rlike(rule.hint), spans).otherwise(empty)


def find_spans(
    text: Column, rules: tuple[Rule, ...] = RULES, due: list[Column] | None = None
) -> Column:
    """All spans of a text, by start, then in the order of the rules. Null: none. ``due``
    says of each rule whether it is applied to the text."""
    text = F.coalesce(text, F.lit(""))
    every = [_rule_spans(text, rule, rank) for rank, rule in enumerate(rules)]
    if due is not None:
        none = F.lit([]).cast(f"array<{SPAN}>")
        every = [F.when(wanted, spans).otherwise(none) for wanted, spans in zip(due, every)]
    return F.array_sort(F.concat(*every))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda span: span["rank"] < len(BASE))


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined; the empty text where there are none."""
    return F.array_join(
        F.transform(
            spans,
            lambda span: F.concat_ws(
                ":", span["kind"], span["start"].cast("string"), span["end"].cast("string")
            ),
        ),
        ",",
    )


def scan_history(
    versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Findings in every version of every path.

    ``versions`` has ``content`` (null: empty) and any columns that name path and
    version. Its rows come back, without the content, with ``blob``, ``spans`` and
    ``n_found`` (number of spans by kind). Equal contents are scanned once, whichever
    paths held them; a content that very many versions share is reduced to one row
    per task before it is shuffled. Repeated rows come back repeated, an empty table
    as an empty one; columns named like the result's are replaced.

    The ledger is a Parquet folder of ``LEDGER_SCHEMA``. Two runs at once may scan the
    same blob twice, with the same outcome; readers take one entry of a pair.
    """
    spark = versions.sparkSession
    version_of = {rule_version(r): r for r in rules}
    wanted = F.array(*[F.lit(name) for name in version_of])
    content = F.coalesce(F.col("content"), F.lit(""))
    blob = F.unhex(F.sha2(content.cast("binary"), 256))
    known = (
        spark.read.schema(LEDGER_SCHEMA)
        .parquet(ledger)
        .select("blob", F.explode("rules").alias("rule"))
        .filter(F.col("rule").isin(*version_of))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("known"))
    )
    none = F.array().cast("array<string>")
    unseen = (
        versions.select(blob.alias("blob"), content.alias("content"))
        .groupBy("blob")
        .agg(F.any_value("content").alias("content"))
        .join(known, "blob", "left")
        .withColumn("rules", F.array_except(wanted, F.coalesce("known", none)))
        .filter(F.size("rules") > 0)
    )
    # Only the rules that a blob has not met yet are applied to it.
    due = [F.array_contains("rules", name) for name in version_of]
    unseen.select(
        "blob", "rules", find_spans(F.col("content"), rules, due).alias("spans")
    ).write.mode("append").parquet(ledger)

    # A span counts if the rule that found it is one of these, in this version.
    pairs = lambda items: F.create_map(*[F.lit(x) for pair in items for x in pair])
    rank = pairs((r.kind, i) for i, r in enumerate(rules))
    current = pairs((r.kind, name) for name, r in version_of.items())
    counted = F.transform(
        F.filter("spans", lambda span: F.array_contains("rules", current[span["kind"]])),
        lambda span: span.withField("rank", rank[span["kind"]]),
    )
    # A blob that two runs scanned at once has its spans twice; they count once.
    entries = (
        spark.read.schema(LEDGER_SCHEMA)
        .parquet(ledger)
        .filter(F.size("spans") > 0)
        .select("blob", counted.alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    )
    taken = ("content", "blob", "spans", "n_found")
    paths = versions.select(
        *[F.col(f"`{c}`") for c in versions.columns if c not in taken], blob.alias("blob")
    )
    empty = F.lit([]).cast(f"array<{SPAN}>")
    spans = F.coalesce(F.col("spans"), empty)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda span: span["kind"] == kind)).cast("long")

    counts = reduce(
        lambda pairs, r: [*pairs, F.lit(r.kind), count(r.kind)], rules, []
    )
    return paths.join(entries, "blob", "left").select(
        *paths.columns, spans.alias("spans"), F.create_map(*counts).alias("n_found")
    )


def redacted(text: Column, spans: Column, sign: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a sign."""
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.lit("").alias("out")
    )

    def step(done: Column, span: Column) -> Column:
        before = F.substring(
            text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")
        )
        return F.when(
            span["start"] >= done["at"],
            F.struct(
                span["end"].alias("at"), F.concat(done["out"], before, F.lit(sign)).alias("out")
            ),
        ).otherwise(
            F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["out"].alias("out"))
        )

    def rest(done: Column) -> Column:
        return F.concat(
            done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
        )

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: spans of one rule, found from the parts between the matches."""
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT row_no, {rank} AS rank, '{kind}' AS kind,
           CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT)
             AS start,
           length(found[i]) AS size
    FROM (SELECT row_no, gaps, found, inside, unnest(range(1, len(found) + 1)) AS i
          FROM (SELECT row_no, string_split_regex(body, '{quoted}') AS gaps,
                       regexp_extract_all(body, '{quoted}', 0) AS found,
                       regexp_extract_all(body, '{quoted}', {group}) AS inside
                FROM numbered))
    WHERE length(inside[i]) >= {least}"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the op7 query, from documents alone."""
    every = " UNION ALL ".join(
        _sql_spans(r.kind, rank, r.pattern, r.group, r.least) for rank, r in enumerate(rules)
    )
    item = "kind || ':' || start || ':' || (start + size)"
    counts = ", ".join(
        f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in BASE
    )
    joined = f"string_agg({item}, ',' ORDER BY start, rank)"
    return f"""
    WITH numbered AS (
      SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents
    ), spans AS ({every}),
    listed AS (
      SELECT row_no, {counts}, {joined} AS spans,
             {joined} FILTER (rank < {len(BASE)}) AS base
      FROM spans GROUP BY row_no)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM numbered LEFT JOIN listed USING (row_no)"""


SECRET_SQL = oracle_sql()
