"""Model responses as Column expressions: parsing, padding, validity and reasons for rejection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tkanyna.functions.text import _col, clean, strip, without_numbering

# What shows that a text is part of a JSON reply.
JSON_PARTS = (r'^\s*\{\s*"translations"', r"^\s*\[", r'^\s*"[^"]*",?\s*$', r"translations\s*:")
# Patterns that mark a failed generation; they are part of the reason that is reported.
ERROR_PATTERNS = (r"<SEP>.*<SEP>", r"^\d+\.\s+", r"^Переклад:", r"^Відповідь:")
# The reasons for rejection.
PARSE_ERROR = "json_parse_error"
EMPTY = "empty source or translation"
ARTIFACT = "JSON artifact in translation"
IDENTICAL = "translation identical to source"
TOO_SHORT = "translation too short"
ELEMENT = "translation looks like JSON string element"
# Openings of lines that are no translation.
SKIPPED_STARTS = ("<s>", "Відповідь", "Переклад")
SKIPPED_PART = "[OUT]"
ARROW = "→"
EMBEDDED = r'(?s)\{[^{}]*"translations"\s*:\s*\[[^\]]*\][^{}]*\}'


def finds(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, with Unicode classes and lines that end at \\n only."""
    return c.rlike(f"(?dU){pattern}")


def _artifact(t: Column) -> Column:
    found = finds(t, JSON_PARTS[0])
    for p in JSON_PARTS[1:]:
        found = found | finds(t, p)
    return found


def is_valid(c: Column | str) -> Column:
    """Whether a cleaned translation is kept by the generator; null and single characters are not."""
    t = _col(c)
    good = (F.length(strip(t)) >= 2) & ~_artifact(t) & ~(t.startswith('"') & t.endswith('",'))
    return F.coalesce(good, F.lit(False))


def reject_reason(source: Column | str, translation: Column | str) -> Column:
    """The first reason to reject a pair, or null; nulls count as empty."""
    s, t = F.coalesce(_col(source), F.lit("")), F.coalesce(_col(translation), F.lit(""))
    out = (
        F.when((s == "") | (t == ""), EMPTY)
        .when(_artifact(t), ARTIFACT)
        .when(strip(s) == strip(t), IDENTICAL)
        .when(F.length(strip(t)) < 2, TOO_SHORT)
        .when(t.startswith('"') & t.endswith('",'), ELEMENT)
    )
    for p in ERROR_PATTERNS:
        out = out.when(finds(t, p), f"error pattern: {p}")
    return out


def fitted(translations: Column, count: Column | int) -> Column:
    """An array cut, or filled with empty strings, to count elements."""
    n = F.lit(count) if isinstance(count, int) else count
    return F.slice(F.concat(translations, F.array_repeat(F.lit(""), n)), F.lit(1), n)


def parse_json(response: Column | str, count: Column | int) -> Column:
    """The cleaned translations of a JSON reply, fitted to count, or null for anything else.

    Trailing text behind the object makes it no JSON reply.
    """
    r = strip(response)
    parsed = F.from_json(r, "translations ARRAY<STRING>, _corrupt_record STRING", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt_record"})
    whole = r.startswith("{") & r.endswith("}") & parsed["_corrupt_record"].isNull() & parsed["translations"].isNotNull()
    cleaned = F.transform(parsed["translations"], lambda t: clean(F.coalesce(t, F.lit(""))))
    return F.when(whole, fitted(cleaned, count))


def parse_text(response: Column | str, count: Column | int) -> Column:
    """The translations of a reply in lines, fitted to count; lines that are no translation are skipped."""
    lines = F.transform(F.split(strip(response), "\n"), strip)
    said = F.filter(lines, lambda x: (x != "") & ~x.startswith(SKIPPED_STARTS[0]) & ~x.contains(SKIPPED_PART) & ~x.startswith(SKIPPED_STARTS[1]) & ~x.startswith(SKIPPED_STARTS[2]))
    last = F.transform(said, lambda x: F.when(x.contains(ARROW), strip(F.element_at(F.split(x, ARROW), -1))).otherwise(x))
    bare = F.filter(F.transform(last, without_numbering), lambda x: x != "")
    return fitted(F.transform(bare, clean), count)


def embedded_json(text: Column | str) -> Column:
    """The JSON object with translations inside a text if there is one that parses, else the text."""
    t = _col(text)
    found = F.regexp_extract(t, EMBEDDED, 0)
    parsed = F.from_json(F.when(found != "", found), "translations ARRAY<STRING>, _corrupt_record STRING", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(parsed["_corrupt_record"].isNull() & parsed["translations"].isNotNull(), found).otherwise(t)


def parse_response(response: Column | str, count: Column | int, extract_json: bool = False) -> Column:
    """count translations of a reply; a null or empty reply gives empty ones."""
    r = _col(response)
    if extract_json:
        r = embedded_json(r)
    blank = fitted(F.array().cast("array<string>"), count)
    return F.when(F.coalesce(r == "", F.lit(True)), blank).otherwise(F.coalesce(parse_json(r, count), parse_text(r, count)))


def mask_ids(ids: Column | str, vocabulary: int, pad: int = 0, ignored: int = -100) -> Column:
    """Ids outside 0 .. vocabulary - 1, and ignored labels, as pad."""
    return F.transform(_col(ids), lambda x: F.when((x >= 0) & (x < vocabulary) & (x != ignored), x).otherwise(F.lit(pad)))
