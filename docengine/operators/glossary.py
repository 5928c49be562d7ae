"""Glossary building from model responses or text, and glossary lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.text import fill_template, windows
from docengine.schemas import GLOSSARY_ITEMS
from docengine.session import materialise

# Fixed value: definitions below this certainty are not looked up.
MIN_CERTAINTY = 80

EXTRACTION_PROMPT = (
    "List every acronym that is defined in the document chunk below, with its definition "
    "as stated there and a certainty from 0 to 100. Answer only with a JSON array of objects "
    'with the fields "acronym", "definition" and "certainty".\n'
    "Chunk Text: {content}"
)


def glossary_requests(
    documents: DataFrame,
    width: int,
    step: int | None = None,
    prompt: str = EXTRACTION_PROMPT,
    name_like: str | None = None,
) -> DataFrame:
    """One extraction request per document window.

    ``name_like`` is a LIKE pattern on the file name (``_`` is a wildcard).
    Responses come back as a table and go to ``flatten_responses``.
    """
    chosen = documents if name_like is None else documents.filter(
        F.col("file_name").like(name_like)
    )
    return chosen.select("file_name", F.inline(windows(F.col("text"), width, step))).select(
        "file_name",
        "window_num",
        "start",
        fill_template(prompt, content=F.col("content")).alias("prompt"),
    )


def _items(response: Column) -> Column:
    return F.from_json(response, GLOSSARY_ITEMS)


def flatten_responses(responses: DataFrame, response: str = "glossary_json") -> DataFrame:
    """Glossary rows from JSON responses; unparsable ones give no rows, a lone
    object counts as a list of one and an unreadable field becomes null."""
    return responses.select("file_name", F.inline(_items(F.col(response)))).select(
        "file_name", "acronym", "definition", "certainty"
    )


def rejected_responses(responses: DataFrame, response: str = "glossary_json") -> DataFrame:
    """Responses that are present but cannot be read as glossary items."""
    return responses.filter(F.col(response).isNotNull() & _items(F.col(response)).isNull())


# The name of the SQL function and the columns that it returns.
LOOKUP_FUNCTION = "lookup_glossary"
FOUND = ("definition", "certainty")


def _answers(term: str, min_certainty: int) -> str:
    """The one rule of all lookups, in SQL: an entry answers a term (an SQL expression)
    when it is certain enough and its acronym fits the trimmed term as a pattern."""
    return f"NOT certainty < {int(min_certainty)} AND acronym ILIKE trim({term})"


def _in_order() -> list[Column]:
    """Answers come most certain first, then by definition."""
    return [F.col("certainty").desc(), F.col("definition")]


def create_lookup_function(
    spark: SparkSession, glossary: str, min_certainty: int = MIN_CERTAINTY
) -> None:
    """SQL table function ``lookup_glossary(term)`` over a table or view: ``lookup_term``
    for SQL users. Its columns have the types that they have in the glossary."""
    kinds = dict(spark.table(glossary).dtypes)
    columns = ", ".join(f"{name} {kinds[name]}" for name in FOUND)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {LOOKUP_FUNCTION}(term STRING) "
        f"RETURNS TABLE({columns}) RETURN SELECT {', '.join(FOUND)} FROM {glossary} "
        f"WHERE {_answers('term', min_certainty)} ORDER BY certainty DESC, definition"
    )


def lookup_term(glossary: DataFrame, term: str, min_certainty: int = MIN_CERTAINTY) -> DataFrame:
    """Definitions of one term, most certain first."""
    asked = glossary.withColumn("_term", F.lit(term))
    found = asked.filter(F.expr(_answers("_term", min_certainty)))
    return found.orderBy(*_in_order()).select(*FOUND)


# A pattern is found through one run of its literal characters. Pieces shorter than
# that are held by very many acronyms (the empty one by all), which are spread over
# this many shares; a pattern with such a piece visits them all.
_ANCHOR = 3
_SHARES = 64


def _is_pattern(term: Column) -> Column:
    return F.regexp_like(term, F.lit(r"[%_\\]"))


def _anchor(pattern: Column) -> Column:
    """First characters of the longest literal run; empty if there is none."""
    runs = F.split(pattern, r"\\.|%|_")
    longest = F.element_at(
        F.array_sort(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run")))),
        -1,
    )["run"]
    return F.substring(longest, 1, _ANCHOR)


def _grams(word: Column) -> Column:
    """Distinct pieces of up to ``_ANCHOR`` characters, and the empty one."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda at: F.substring(word, at, F.lit(n)))
        return F.when(F.length(word) >= n, cut).otherwise(F.array().cast("array<string>"))

    pieces = [of_length(n) for n in range(1, _ANCHOR + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *pieces))


def lookup_batch(
    terms: DataFrame,
    glossary: DataFrame,
    term: str = "term",
    min_certainty: int = MIN_CERTAINTY,
) -> DataFrame:
    """The lookup for a table of terms: term, definition, certainty, ``rank``.

    Plain terms meet acronyms by an equality join. Terms with wildcards are
    first resolved against the distinct acronyms: an equality join on a short
    literal piece of the pattern, then ILIKE on what it finds. The glossary
    itself only ever takes part in an equality join on the acronym.
    """
    asked = terms.select(term).distinct().withColumn("_wanted", F.lower(F.trim(F.col(term))))
    known = glossary.filter(
        (F.col("certainty") >= min_certainty) & F.col("acronym").isNotNull()
    ).select(F.lower("acronym").alias("_acronym"), "definition", "certainty")

    plain = asked.filter(~_is_pattern(F.col("_wanted"))).select(
        term, F.col("_wanted").alias("_acronym")
    )
    short = F.length("_gram") < _ANCHOR
    every = F.sequence(F.lit(0), F.lit(_SHARES - 1))
    patterns = (
        asked.filter(_is_pattern(F.col("_wanted")))
        .select(term, "_wanted", _anchor(F.col("_wanted")).alias("_gram"))
        .withColumn("_share", F.explode(F.when(short, every).otherwise(F.array(F.lit(0)))))
    )
    share = F.pmod(F.hash("_acronym"), F.lit(_SHARES))
    pieces = (
        known.select("_acronym")
        .distinct()
        .select("_acronym", F.explode(_grams(F.col("_acronym"))).alias("_gram"))
        .withColumn("_share", F.when(short, share).otherwise(0))
    )
    matched = (
        pieces.join(patterns, ["_gram", "_share"])
        .filter(F.expr("_acronym ILIKE _wanted"))
        .select(term, "_acronym")
    )
    found = plain.unionByName(matched).join(known, "_acronym").select(term, *FOUND)
    return ranked_lookup(found, term)


def ranked_lookup(found: DataFrame, term: str = "term") -> DataFrame:
    """Number each term's definitions, most certain first."""
    order = Window.partitionBy(term).orderBy(*_in_order())
    return found.withColumn("rank", F.row_number().over(order))


# An acronym in parentheses: at least two capitals of any script, with digits,
# hyphens and ampersands, and perhaps a small plural s.
_ACRONYM = r"\((\p{Lu}[\p{N}&-]*+\p{Lu}[\p{Lu}\p{N}&-]*+s?)\)"


def mine_acronyms(
    documents: DataFrame, text: str = "text", min_certainty: int = 1
) -> DataFrame:
    """Acronyms defined in a text as ``Long Form (LF)``, of any length.

    The long form is the last words before the parenthesis, back to the last
    punctuation at most, as many as the acronym has capitals; certainty is the
    share of capitals that begin their word.
    """
    kept = [name for name in documents.columns if name != text]
    found = F.arrays_zip(
        F.split(F.col(text), _ACRONYM, -1).alias("before"),
        F.regexp_extract_all(F.col(text), F.lit(_ACRONYM), F.lit(1)).alias("acronym"),
    )
    clause = F.element_at(F.split("before", r"[^\p{L}\p{N}' -]"), -1)
    words = F.filter(F.split(clause, " "), lambda word: word != "")
    capitals = F.split(F.regexp_replace("acronym", r"[^\p{Lu}]", ""), "")
    letters = F.reverse(F.filter(capitals, lambda letter: letter != ""))
    taken = F.greatest(F.least(F.size("all_words"), F.size(letters)), F.lit(1))
    initials = F.reverse(
        F.transform(F.col("words"), lambda word: F.upper(F.substring(word, 1, 1)))
    )
    hits = F.size(
        F.filter(F.zip_with(letters, initials, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda hit: hit)
    )
    certainty = F.floor(hits * 100 / F.size(letters)).cast("int")
    return (
        documents.filter(F.col(text).contains("("))
        .select(*kept, F.inline(found))
        .filter(F.col("acronym").isNotNull())
        .filter(F.col("before").endswith(" "))
        .withColumn("all_words", words)
        .withColumn("words", F.slice("all_words", -taken, taken))
        .select(
            *kept,
            "acronym",
            F.array_join("words", " ").alias("definition"),
            certainty.alias("certainty"),
        )
        .filter(F.col("certainty") >= min_certainty)
    )


def align_acronyms(documents: DataFrame, text: str = "text") -> DataFrame:
    """Acronyms with long forms whose letters may lie inside words: ``Long Form (LF)``.

    The letters and digits of the acronym are matched from right to left, each at its last
    place before the one matched before it; the first must begin a word, where the long
    form starts. It lies in the words before the parenthesis, back to the last sign other
    than a hyphen or an apostrophe: at most min(n + 5, 2n) of them for n letters. Forms that are no
    longer than the acronym, or hold it as a word, are none. One pass per acronym, in the JVM.
    """
    kept = [name for name in documents.columns if name != text]
    found = F.arrays_zip(
        F.split(F.col(text), _ACRONYM, -1).alias("before"),
        F.regexp_extract_all(F.col(text), F.lit(_ACRONYM), F.lit(1)).alias("acronym"),
    )
    letters = F.reverse(F.regexp_extract_all(F.lower("acronym"), F.lit(r"[\p{L}\p{N}]"), F.lit(0)))
    clause = F.element_at(F.split("before", r"[^\p{L}\p{N}' -]"), -1)
    words = F.filter(F.split(clause, " "), lambda word: word != "")
    most = F.greatest(F.least(F.size("letters") + 5, F.size("letters") * 2, F.size("words")), F.lit(1))
    # Two views of the window, place for place: all letters, and those that begin words.
    whole = F.lower("window")
    begins = F.regexp_replace(whole, r"(?<=[\p{L}\p{N}])[\p{L}\p{N}]", " ")

    def last_place(view: Column, letter: Column, before: Column) -> Column:
        """1-based, 0 if the letter is not there."""
        behind = F.call_function("locate", letter, F.reverse(F.substring(view, F.lit(1), before - 1)))
        return F.when((before > 1) & (behind > 0), before - behind).otherwise(0)

    inner = F.slice("letters", 1, F.size("letters") - 1)
    before = F.aggregate(
        inner, F.length("window") + 1, lambda at, letter: last_place(F.col("whole"), letter, at)
    )
    start = last_place(F.col("begins"), F.element_at("letters", -1), F.col("at"))
    as_word = F.array_contains(F.split("definition", "[ -]"), F.col("acronym"))
    return (
        documents.filter(F.col(text).contains("("))
        .select(*kept, F.inline(found))
        .filter(F.col("acronym").isNotNull() & F.col("before").endswith(" "))
        .withColumn("letters", letters)
        .withColumn("words", words)
        .withColumn("window", F.array_join(F.slice("words", -most, most), " "))
        .withColumn("whole", whole)
        .withColumn("begins", begins)
        .withColumn("at", before)
        .withColumn("start", start)
        .filter(F.col("start") > 0)
        .withColumn("definition", F.substring("window", F.col("start"), F.length("window")))
        .filter((F.length("definition") > F.length("acronym")) & ~as_word)
        .select(*kept, "acronym", "definition")
    )


# Fixed value: the name of the SQL function that is asked once per row.
LATERAL_FUNCTION = "lookup_glossary_of"


def create_lateral_lookup(
    spark: SparkSession, glossary: DataFrame, min_certainty: int = MIN_CERTAINTY
) -> None:
    """SQL table function for ``LEFT JOIN LATERAL lookup_glossary_of(t.term)``.

    The rule is that of ``lookup_glossary``. The glossary is stored by the pieces of its
    acronyms, and a term asks for one of its literal pieces, so that Spark turns the
    lateral join into an equality join with the pattern as a further condition.
    """
    pieces = materialise(
        glossary.filter(F.col("acronym").isNotNull()).select(
            F.explode(_grams(F.lower("acronym"))).alias("piece"), "acronym", *FOUND
        ),
        "pieces",
    )
    pieces.createOrReplaceTempView("glossary_pieces")
    kinds = dict(glossary.dtypes)
    columns = ", ".join(f"{name} {kinds[name]}" for name in FOUND)
    runs = r"split(lower(trim(term)), r'\\.|%|_')"
    longest = f"element_at(array_sort(transform({runs}, run -> struct(length(run) AS n, run AS run))), -1).run"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {LATERAL_FUNCTION}(term STRING) RETURNS TABLE({columns}) "
        f"RETURN SELECT {', '.join(FOUND)} FROM glossary_pieces "
        f"WHERE piece = substring({longest}, 1, {_ANCHOR}) AND {_answers('term', min_certainty)}"
    )
