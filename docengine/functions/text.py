"""Text functions over columns: cleaning, year extraction, names, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a Unicode-aware `\s` covers in the source texts.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Fixed value: month names that count as a date, in calendar order.
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)

# Fixed patterns: labelled year, "in <month> ... year", plain date.
# (?iUd): ignore case, Unicode classes, only \n ends a line. Each of the first
# two patterns is anchored to a line start and stops at the line's first
# keyword: a later keyword can only succeed where the first one does, so this
# finds the same year without rescanning the line from every keyword.
_LABELLED = r"(?iUdm)^(?>.*?Publication date:).*?(\d{4})"
_IN_MONTH = (
    r"(?iUdm)^(?>.*?(?:published|in|updated))"
    rf"(?>.*?\b(?:{MONTHS})\b).*?(\d{{4}})"
)
_PLAIN_DATE = (
    rf"(?iUd)\b\d{{1,2}}\b\s+(?:{MONTHS})\s+\d{{4}}|(?:{MONTHS})\s+\d{{4}}"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A lambda variable is the one place Catalyst does not inline an expression
    into every use, which matters when ``body`` is itself a higher-order call.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text: Column) -> Column:
    """Line breaks and white-space runs become one space; ends are stripped."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def strip(text: Column) -> Column:
    """Strip Unicode white space at both ends (``trim`` only strips spaces)."""
    return F.regexp_replace(text, rf"^{WHITE_SPACE}|{WHITE_SPACE}\z", "")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_year(text: Column) -> Column:
    """Publication year as text: labelled date, then "in <month>", then a date."""
    def matched(given: Column) -> Column:
        by_date = _found(F.regexp_extract(given, _PLAIN_DATE, 0), r"(?U)\d{4}", 0)
        year = F.coalesce(_found(given, _LABELLED, 1), _found(given, _IN_MONTH, 1), by_date)
        return F.when(F.regexp_like(given, F.lit(r"(?U)\d{4}")), year)

    return let(text, matched)


def join_parts(parts: Column, separator: str = "\n") -> Column:
    """Join the non-empty parts of an array."""
    return F.array_join(F.filter(parts, lambda part: part != ""), separator)


def text_length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(name: Column) -> Column:
    """Lower-cased extension with its dot; leading dots are part of the name."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))


TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN + "+"), F.lit(0))


def windows(text: Column, width: int, step: int | None = None) -> Column:
    """All windows of a text as ``array<struct<window_num, start, content>>``.

    ``start`` is 1-based as in ``substring``. Adjoining windows are cut in one
    regular-expression pass, so the cost is linear in the text.
    """
    step = width if step is None else step
    if step == width:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
        return F.transform(
            pieces,
            lambda piece, i: F.struct(
                i.alias("window_num"),
                (i * step + 1).alias("start"),
                piece.alias("content"),
            ),
        )
    starts = F.when(
        F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(step))
    )
    return F.transform(
        starts,
        lambda start, i: F.struct(
            i.alias("window_num"),
            start.alias("start"),
            F.substring(text, start, F.lit(width)).alias("content"),
        ),
    )


def fill_template(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a template, in a single pass."""
    parts: list[Column] = []
    rest = template
    while rest:
        places = {rest.find("{" + name + "}"): name for name in values}
        found = sorted(at for at in places if at >= 0)
        if not found:
            parts.append(F.lit(rest))
            break
        at = found[0]
        name = places[at]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def json_string(text: Column) -> Column:
    """A string as a quoted JSON literal; null becomes ``null``."""
    listed = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
