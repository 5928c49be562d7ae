"""Chunking text into overlapping, size-limited or combined pieces.

Everything here is a Spark expression over one row, so chunking is a narrow
stage: scan, project, generate, with no shuffle and no Python worker. Folds
carry numbers and a packed string of cut marks only, because Spark copies the
fold state at every step, and they run in two levels, so that the string that is
copied holds the marks of one run of items; strings are cut out once, from arrays
bound by ``let``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import fill_template, let

EDGES = " \n\t\r\f\v"
CATEGORY = "CompositeElement"
BLANK_LINE = r"\n\s*\n"

# Unicode noncharacters, never part of interchanged text: element boundary,
# table boundary and table mark. The boundary plus a line break has the length
# of the blank line that finally stands between elements.
_BREAK, _WALL, _TABLE = "\ufdd0", "\ufdd1", "\ufdd2"


def _edges_off(text: Column) -> Column:
    return F.trim(text, F.lit(EDGES))


def _body_length(tile: Column) -> Column:
    return F.length(F.rtrim(tile, F.lit(EDGES)))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# Items that an inner fold takes between two additions to all marks so far.
RUN = 512


def _fold_in_runs(items: Column, start: Column, step) -> Column:
    """The last state of a fold whose state has ``marks``, text that only grows."""

    def run_over(state: Column, run: Column) -> Column:
        ended = F.aggregate(run, state.withField("marks", F.lit("")), step)
        return let(
            ended,
            lambda new: new.withField("marks", F.concat(state["marks"], new["marks"])),
        )

    def over_runs(given: Column) -> Column:
        last = F.floor((F.greatest(F.size(given), F.lit(1)) - 1) / RUN).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), last), lambda at: F.slice(given, at * RUN + 1, F.lit(RUN))
        )
        return F.aggregate(runs, start, run_over)

    return let(items, over_runs)


def _tiles(text: Column, size: int) -> Column:
    """Cut a text into tiles whose bodies fit ``size``; joined they are the text.

    Paragraphs first, then the lines of a paragraph that is too long, the words
    of a line that is too long, and slices of a word that is too long.
    """
    levels = [
        r"(?s).*?\n\n|.+\z",
        r"(?d).*+\n(?:\n+\z)?|.+\z",
        r"[^ ]* |[^ ]+\z",
        f"(?s).{{1,{size}}}",
    ]

    def cut(tile: Column, depth: int) -> Column:
        pieces = _all(tile, levels[depth])
        if depth == len(levels) - 1:
            return pieces
        return F.flatten(
            F.transform(
                pieces,
                lambda piece: F.when(_body_length(piece) <= size, F.array(piece)).otherwise(
                    cut(piece, depth + 1)
                ),
            )
        )

    return cut(text, 0)


def recursive_chunks(text: Column, size: int = 1500, overlap: int = 500) -> Column:
    """Overlapping chunks: ``array<struct<content, char_length, chunk_num>>``.

    A chunk runs over tiles while its span is at most ``size``. The next one
    starts at the earliest tile of the last ``overlap`` characters from which
    the following tile still fits, else at that tile. Empty text gives none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def step(state: Column, tile: Column) -> Column:
        end = state["at"] + tile["body"]
        fits = (F.size(state["starts"]) == 0) | (end - state["begin"] <= size)
        kept = F.filter(
            state["starts"],
            lambda start: (state["end"] - start <= overlap) & (end - start <= size),
        )
        here = F.array(state["at"])
        extended = F.struct(
            (state["at"] + tile["whole"]).alias("at"),
            F.when(F.size(state["starts"]) == 0, state["at"])
            .otherwise(state["begin"])
            .alias("begin"),
            end.alias("end"),
            state["first"].alias("first"),
            F.concat(state["starts"], here).alias("starts"),
            state["marks"].alias("marks"),
        )
        restarted = let(
            kept,
            lambda tail: F.struct(
                (state["at"] + tile["whole"]).alias("at"),
                F.when(F.size(tail) > 0, F.get(tail, F.lit(0)))
                .otherwise(state["at"])
                .alias("begin"),
                end.alias("end"),
                (state["first"] + F.size(state["starts"]) - F.size(tail)).alias("first"),
                F.concat(tail, here).alias("starts"),
                F.concat(
                    state["marks"],
                    state["first"].cast("string"),
                    F.lit(":"),
                    F.size(state["starts"]).cast("string"),
                    F.lit(" "),
                ).alias("marks"),
            ),
        )
        return F.when(fits, extended).otherwise(restarted)

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("begin"),
        F.lit(0).alias("end"),
        F.lit(1).alias("first"),
        F.array().cast("array<int>").alias("starts"),
        F.lit("").alias("marks"),
    )

    def spans(tiles: Column) -> Column:
        measured = F.transform(
            tiles,
            lambda tile: F.struct(
                _body_length(tile).alias("body"), F.length(tile).alias("whole")
            ),
        )
        marks = let(
            _fold_in_runs(measured, start, step),
            lambda state: F.concat(
                state["marks"],
                state["first"].cast("string"),
                F.lit(":"),
                F.size(state["starts"]).cast("string"),
            ),
        )
        return F.transform(F.split(marks, " "), lambda mark: F.split(mark, ":").cast("array<int>"))

    contents = let(
        _tiles(text, size),
        lambda tiles: F.transform(
            F.filter(spans(tiles), lambda span: span[1] > 0),
            lambda span: _edges_off(F.array_join(F.slice(tiles, span[0], span[1]), "")),
        ),
    )
    return F.transform(
        F.filter(contents, lambda content: content != ""),
        lambda content, i: F.struct(
            content.alias("content"),
            F.length(content).alias("char_length"),
            i.alias("chunk_num"),
        ),
    )


def split_elements(text: Column, max_characters: int, element_regex: str = BLANK_LINE) -> Column:
    """Trimmed, non-empty elements, those over the limit cut at their last spaces."""
    elements = F.filter(
        F.transform(F.split(text, element_regex), _edges_off), lambda element: element != ""
    )
    return F.flatten(
        F.transform(
            elements,
            lambda element: F.when(F.length(element) <= max_characters, F.array(element)).otherwise(
                _cut_long(element, max_characters)
            ),
        )
    )


def _cut_long(element: Column, limit: int) -> Column:
    pieces = _all(element, rf"(?s).{{1,{limit}}}(?: |\z)|.{{{limit}}}")
    return F.filter(F.transform(pieces, _edges_off), lambda piece: piece != "")


def _sized_pattern(max_characters: int, new_after: int) -> str:
    """One chunk of joined elements as a regular expression.

    The shortest run of whole elements that reaches the soft limit within the
    hard one; where there is none, the longest run below the soft limit.
    """
    soft = max(1, min(new_after, max_characters))
    edge = rf"(?={_BREAK}|\z)"
    pattern = rf".{{{soft},{max_characters}}}?{edge}"
    if soft > 1:
        pattern += rf"|.{{1,{soft - 1}}}{edge}"
    return rf"(?s)(?![\s{_BREAK}])(?:{pattern})"


def _numbered(contents: Column, category: Column | None = None) -> Column:
    return F.transform(
        contents,
        lambda content, i: F.struct(
            content.alias("content"),
            (F.lit(CATEGORY) if category is None else category).alias("category"),
            F.length(content).alias("char_length"),
            i.alias("chunk_num"),
        ),
    )


def sequential_chunks(
    text: Column,
    max_characters: int = 1500,
    new_after: int = 1000,
    element_regex: str = BLANK_LINE,
) -> Column:
    """Whole elements packed in order: a chunk closes once it reaches the soft
    limit or when the next element would pass the hard one.

    Returns ``array<struct<content, category, char_length, chunk_num>>``.
    """
    joined = F.array_join(
        split_elements(text, max_characters, element_regex), _BREAK + "\n"
    )
    chunks = _all(joined, _sized_pattern(max_characters, new_after))
    return _numbered(
        F.transform(chunks, lambda chunk: F.replace(chunk, F.lit(_BREAK), F.lit("\n")))
    )


def sequential_chunks_of(
    elements: Column, max_characters: int = 1500, new_after: int = 1000
) -> Column:
    """As ``sequential_chunks`` over ``array<struct<text, kind, html>>``.

    An element of kind ``Table`` stands alone and keeps its HTML as content.
    """
    marked = F.filter(
        F.flatten(
            F.transform(
                elements,
                lambda element, i: F.when(
                    element["kind"] == "Table",
                    F.array(F.concat(F.lit(_WALL + _TABLE), i.cast("string"), F.lit(_WALL))),
                ).otherwise(
                    F.when(
                        F.length(element["text"]) <= max_characters,
                        F.array(_edges_off(element["text"])),
                    ).otherwise(_cut_long(element["text"], max_characters))
                ),
            )
        ),
        lambda piece: piece != "",
    )
    joined = F.array_join(marked, _BREAK + "\n")
    # A wall replaces the break beside it, so no chunk begins with an empty element.
    walled = F.regexp_replace(joined, rf"(?:{_BREAK}\n)?{_WALL}(?:{_BREAK}\n)?", _WALL)
    pattern = _sized_pattern(max_characters, new_after)
    chunks = F.flatten(F.transform(F.split(walled, _WALL), lambda run: _all(run, pattern)))
    return let(
        elements,
        lambda given: F.transform(
            chunks,
            lambda chunk, i: let(
                F.when(
                    chunk.startswith(_TABLE),
                    F.get(given, F.substring(chunk, 2, 20).cast("int"))["html"],
                ).otherwise(F.replace(chunk, F.lit(_BREAK), F.lit("\n"))),
                lambda content: F.struct(
                    content.alias("content"),
                    F.when(chunk.startswith(_TABLE), "Table")
                    .otherwise(CATEGORY)
                    .alias("category"),
                    F.length(content).alias("char_length"),
                    i.alias("chunk_num"),
                ),
            ),
        ),
    )


def _packed(elements: Column, limit: int, joint: int) -> Column:
    """Groups of consecutive elements, ``array<struct<raw, chars>>``.

    An element joins while the length so far plus its own is within ``limit``;
    ``joint`` is what each joining then adds to the length besides the element.
    The group open at the beginning is empty text and keeps a leading space.
    """
    ended = _fold_in_runs(
        F.transform(elements, lambda element: F.length(element)),
        F.struct(
            F.lit(0).alias("chars"), F.lit(0).alias("at"), F.lit("0").alias("marks")
        ),
        lambda state, n: F.when(
            state["chars"] + n <= limit,
            F.struct(
                (state["chars"] + n + joint).alias("chars"),
                (state["at"] + 1).alias("at"),
                state["marks"].alias("marks"),
            ),
        ).otherwise(
            F.struct(
                n.alias("chars"),
                (state["at"] + 1).alias("at"),
                F.concat(state["marks"], F.lit(" "), state["at"].cast("string")).alias("marks"),
            )
        ),
    )
    folded = let(
        ended, lambda state: F.concat(state["marks"], F.lit(" "), state["at"].cast("string"))
    )

    def group(members: Column, i: Column) -> Column:
        lead = F.when((i == 0) & (F.size(members) > 0), " ").otherwise("")
        return F.struct(
            F.concat(lead, F.array_join(members, " ")).alias("raw"),
            F.aggregate(
                members, F.lit(0), lambda chars, member: chars + F.length(member)
            ).alias("chars"),
        )

    return let(
        F.split(folded, " ").cast("array<int>"),
        lambda marks: F.filter(
            F.transform(
                F.slice(marks, F.lit(1), F.size(marks) - 1),
                lambda mark, i: F.struct(
                    group(
                        F.slice(elements, mark + 1, F.get(marks, i + 1) - mark), i
                    ).alias("group"),
                    (i == F.size(marks) - 2).alias("last"),
                ),
            ),
            lambda item: ~item["last"] | (item["group"]["raw"] != ""),
        ),
    )


def combine_elements(elements: Column, max_characters: int) -> Column:
    """Element texts joined by spaces up to a limit: ``array<string>``."""
    return let(
        F.transform(elements, _edges_off),
        lambda trimmed: F.transform(
            _packed(trimmed, max_characters, joint=1),
            lambda item: _edges_off(item["group"]["raw"]),
        ),
    )


def combine_small_chunks(chunks: Column, max_characters: int) -> Column:
    """Chunks merged up to a limit: ``array<struct<content, char_length>>``.

    ``char_length`` counts the chunk texts, not the spaces that join them.
    """
    return let(
        chunks,
        lambda given: F.transform(
            _packed(given, max_characters, joint=0),
            lambda item: F.struct(
                item["group"]["raw"].alias("content"),
                item["group"]["chars"].alias("char_length"),
            ),
        ),
    )


def chunk_documents(documents: DataFrame, chunks: Column, only_ok: bool = True) -> DataFrame:
    """Gold chunk rows: the document columns without ``text``, the chunk fields
    and ``uuid`` = file name, underscore, chunk number."""
    source = documents
    if only_ok and "status" in documents.columns:
        source = source.filter(F.col("status") == "ok")
    kept = [name for name in documents.columns if name not in ("text", "status")]
    return (
        source.select(*kept, F.inline(chunks))
        .withColumn("uuid", F.concat_ws("_", F.col("file_name"), F.col("chunk_num")))
    )


CHUNK_PROMPT = (
    "Divide the document below into passages that each stay with one subject, cut at its own "
    "paragraphs or sections and of any length. Keep the wording exactly. Answer only with a JSON "
    'array of objects with the fields "chunk_number" (from 1) and "content".\n'
    "The document:\n{document}"
)


def chunk_requests(documents: DataFrame, prompt: str = CHUNK_PROMPT) -> DataFrame:
    """One request per document for model-suggested chunks, the whole text in it;
    responses come back as a table and go to ``suggested_chunks``."""
    return documents.select("file_name", fill_template(prompt, document=F.col("text")).alias("prompt"))


def suggested_chunks(responses: DataFrame, text: str = "text", response: str = "response") -> DataFrame:
    """Rows from model-suggested chunks given as JSON, possibly in single quotes.

    ``verbatim`` tells whether the chunk occurs unchanged in its source text.
    Responses that are no JSON array, a lone object among them, give no rows.
    """
    from docengine.schemas import MODEL_CHUNKS

    listed = F.trim(F.trim(F.col(response), F.lit("'")), F.lit(EDGES))
    parsed = F.when(listed.startswith("["), F.from_json(listed, MODEL_CHUNKS))
    kept = [name for name in responses.columns if name not in (text, response)]
    return responses.select(*kept, text, F.inline(parsed)).select(
        *kept,
        "chunk_number",
        "content",
        F.contains(F.col(text), F.col("content")).alias("verbatim"),
    )


PLACES = "array<struct<start:int,end:int,gap:int>>"


def place_chunks(text: Column, contents: Column) -> Column:
    """Where chunks lie in their text, in their order: an array of ``PLACES``.

    A chunk is looked for behind the end of the one before, and if it is not there, behind
    its start (it then overlaps); one that is in neither place, or empty, has nulls and the
    next one starts from where this one did. ``start`` is 1-based, ``end`` is the place
    after the last character, ``gap`` the characters since the furthest end so far (negative:
    an overlap). Every chunk is searched from its place on in the text.
    """
    state = F.struct(
        F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("reach"), F.lit("").alias("marks")
    )

    def step(done: Column, content: Column) -> Column:
        behind = F.call_function("locate", content, text, done["end"])
        found = F.when(F.length(content) == 0, 0).otherwise(
            F.coalesce(
                F.nullif(behind, F.lit(0)), F.call_function("locate", content, text, done["start"] + 1)
            )
        )

        def after(start: Column) -> Column:
            end = start + F.length(content)
            put = F.concat_ws(",", start.cast("string"), end.cast("string"), (start - done["reach"]).cast("string"))
            return F.when(
                F.coalesce(start, F.lit(0)) > 0,
                F.struct(
                    start.alias("start"), end.alias("end"), F.greatest(done["reach"], end).alias("reach"),
                    F.concat(done["marks"], put, F.lit(";")).alias("marks"),
                ),
            ).otherwise(done.withField("marks", F.concat(done["marks"], F.lit(";"))))

        return let(found, after)

    def place(mark: Column) -> Column:
        numbers = F.split(mark, ",")
        at = lambda i: F.when(mark != "", F.get(numbers, F.lit(i)).cast("int"))
        return F.struct(at(0).alias("start"), at(1).alias("end"), at(2).alias("gap"))

    marks = F.split(_fold_in_runs(contents, state, step)["marks"], ";")
    # Behind the last semicolon there is nothing.
    return F.transform(F.slice(marks, 1, F.size(marks) - 1), place).cast(PLACES)


def placed_chunks(responses: DataFrame, text: str = "text", response: str = "response") -> DataFrame:
    """Model-suggested chunks with their place: ``chunk_number, content, start, end, gap``.

    Chunks are taken in the order of the response. Unplaced ones have nulls.
    """
    from docengine.schemas import MODEL_CHUNKS

    listed = F.trim(F.trim(F.col(response), F.lit("'")), F.lit(EDGES))
    parsed = F.when(listed.startswith("["), F.from_json(listed, MODEL_CHUNKS))
    kept = [name for name in responses.columns if name not in (text, response)]
    places = place_chunks(F.col(text), F.transform("_parsed", lambda chunk: F.coalesce(chunk["content"], F.lit(""))))
    fields = [F.col(f"_chunk._parsed.{name}").alias(name) for name in ("chunk_number", "content")]
    fields += [F.col(f"_chunk._places.{name}").alias(name) for name in ("start", "end", "gap")]
    return (
        responses.select(*kept, text, parsed.alias("_parsed"))
        .filter(F.col("_parsed").isNotNull())
        .select(*kept, F.length(text).alias("text_length"), "_parsed", places.alias("_places"))
        .select(*kept, "text_length", F.explode(F.arrays_zip("_parsed", "_places")).alias("_chunk"))
        .select(*kept, "text_length", *fields)
    )


def chunk_coverage(placed: DataFrame, key: str) -> DataFrame:
    """Per document: chunks, those that are placed, characters covered and their share, and
    characters in gaps before chunks and in overlaps."""
    covered = F.when(F.col("start").isNotNull(), F.col("end") - F.col("start") + F.least("gap", F.lit(0)))
    return (
        placed.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.count("start").alias("placed"),
            F.coalesce(F.sum(F.greatest(covered, F.lit(0))), F.lit(0)).alias("covered"),
            F.coalesce(F.sum(F.greatest("gap", F.lit(0))), F.lit(0)).alias("in_gaps"),
            F.coalesce(F.sum(F.greatest(-F.col("gap"), F.lit(0))), F.lit(0)).alias("in_overlaps"),
            F.max("text_length").alias("_length"),
        )
        .withColumn("share", F.round(F.col("covered") / F.col("_length"), 6))
        .drop("_length")
    )
