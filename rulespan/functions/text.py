"""Text expressions: page text, code blocks, labelled reports, urls, file headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a character in a web page, decoded in this order (ampersand last).
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]

# The labels of a review report and the words that may follow them.
REPORT_ANALYSIS = "CODE_ANALYSIS"
REPORT_RECOMMENDATIONS = "IMPROVEMENT_RECOMMENDATIONS"
REPORT_POTENTIAL = "OPTIMIZATION_POTENTIAL"
REPORT_DECISION = "FINAL_RECOMMENDATION"
POTENTIALS = ["High", "Medium", "Low", "None"]
DECISIONS = ["CONTINUE OPTIMIZATION", "TERMINATE OPTIMIZATION"]
CONTINUE = DECISIONS[0]


def page_text(html: Column) -> Column:
    """The readable text of a page: no scripts, styles or tags, entities decoded, whitespace folded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Whitespace cut off at both ends of a text.
BLANKS = " \t\n\r\x0b\x0c"


def stripped(col: Column) -> Column:
    """Without whitespace at both ends, line breaks included."""
    return F.btrim(col, F.lit(BLANKS))


FENCE = "```"


def _fenced(col: Column, language: str) -> Column:
    """What stands between the first two fences, without the language's name at its start; NULL without two."""
    inside = F.get(F.split(col, FENCE, 3), F.lit(1))
    bare = F.when(F.startswith(inside, F.lit(language)), F.substr(inside, F.lit(len(language) + 1))).otherwise(inside)
    return F.when(F.size(F.split(col, FENCE, 3)) == 3, stripped(bare))


def first_code_block(col: Column) -> Column:
    """The content of the first fenced block, or the text as it is when there is none."""
    return F.coalesce(_fenced(col, "python"), col)


def json_payload(col: Column) -> Column:
    """The first fenced block, else the widest bracketed span, else the text as it is."""
    spans = []
    for opening, closing in ("[]", "{}"):
        first, last = F.instr(col, opening), F.length(col) - F.instr(F.reverse(col), closing) + 1
        spans.append(F.when((first > 0) & (last <= F.length(col)) & (last > first), F.struct(first.alias("at"), (last - first + 1).alias("size"))))
    widest = F.array_min(F.array_compact(F.array(*spans)))
    return F.coalesce(_fenced(col, "json"), F.substr(col, widest["at"], widest["size"]), col)


def _behind(col: Column, label: str) -> Column:
    """What follows the first ``label:``, NULL without it."""
    at = F.instr(col, f"{label}:")
    return F.when(at > 0, F.substr(col, at + len(label) + 1))


def _until_line(col: Column, label: str) -> Column:
    """What comes before the first line that begins with ``label:``."""
    return F.get(F.split(col, rf"\n\s*{label}:", 2), F.lit(0))


def _choice(col: Column, label: str, words: list[str]) -> Column:
    """The first of ``words`` that follows a ``label:``."""
    parts = F.split(col, f"{label}:")
    behind = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.ltrim(p, F.lit(BLANKS)))
    found = F.transform(behind, lambda p: F.coalesce(*[F.when(F.startswith(p, F.lit(w)), F.lit(w)) for w in words]))
    return F.get(F.array_compact(found), F.lit(0))


def report_sections(col: Column) -> dict[str, Column]:
    """The parts of a labelled review: analysis, recommendations (a list), potential, decision.

    A missing part is NULL, apart from the list, which is then empty, and ``continues``, which is false.
    """
    listed = _until_line(_behind(col, REPORT_RECOMMENDATIONS), REPORT_POTENTIAL)
    # Every item begins on a line with a dash; a line break in front makes the first one like the others.
    items = F.transform(F.split(F.concat(F.lit("\n"), stripped(listed)), r"\n-\s*-?"), stripped)
    decision = _choice(col, REPORT_DECISION, DECISIONS)
    return {
        "analysis": stripped(_until_line(_behind(col, REPORT_ANALYSIS), REPORT_RECOMMENDATIONS)),
        "recommendations": F.coalesce(F.filter(items, lambda i: i != ""), F.array().cast("array<string>")),
        "potential": _choice(col, REPORT_POTENTIAL, POTENTIALS),
        "decision": decision,
        "continues": F.coalesce(decision == CONTINUE, F.lit(False)),
    }


SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"


def url_host(url: Column) -> Column:
    """What stands between ``//`` and the path, port included; empty without ``//``.

    NULL for a host with an unpaired square bracket, which makes a url unreadable.
    """
    host = F.regexp_extract(url, SCHEME + r"//([^/?#]*)", 1)
    return F.when(F.contains(host, F.lit("[")) == F.contains(host, F.lit("]")), host)


def url_path(url: Column) -> Column:
    """The path without query, fragment and the parameters of its last part."""
    path = F.regexp_extract(url, SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def source_name(url: Column) -> Column:
    """A name for a web source: host and last path part, with ``.`` and ``-`` as ``_``."""
    path = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    name = F.when(path == "", url_host(url)).otherwise(F.concat(url_host(url), F.lit("_"), last))
    return F.translate(name, ".-", "__")


# The description of a file that carries none, and the marks of its header lines.
DEFAULT_DESCRIPTION = "Generated code snippet"
HEADER_LINES = 5
TAGS_MARK = "Tags:"
METRICS_MARK = "Metrics:"


def header_fields(text: Column) -> dict[str, Column]:
    """Description and tags from the comment lines among the first five lines; the last of each kind counts."""
    lines = F.filter(F.slice(F.split(text, "\n", HEADER_LINES + 1), 1, HEADER_LINES), lambda line: line.startswith("# "))
    tags = F.filter(lines, lambda line: F.contains(line, F.lit(TAGS_MARK)))
    notes = F.filter(
        lines, lambda line: ~F.contains(line, F.lit(TAGS_MARK)) & ~F.contains(line, F.lit(METRICS_MARK))
    )
    # get() gives NULL for the element before the first, which an empty list asks for.
    return {
        "description": F.coalesce(
            stripped(F.replace(F.get(notes, F.size(notes) - 1), F.lit("#"), F.lit(""))), F.lit(DEFAULT_DESCRIPTION)
        ),
        "tags": F.coalesce(
            stripped(F.replace(F.get(tags, F.size(tags) - 1), F.lit(f"# {TAGS_MARK}"), F.lit(""))), F.lit("")
        ),
    }


def result_row_ids(col: Column) -> Column:
    """The distinct row ids in a stored result: all numbers that are values in the JSON text.

    Keys, strings, booleans and nulls are no ids; fractions are cut off.
    """
    # Escapes go first, so that a string ends at the next quote and a plain character class matches it.
    bare = F.regexp_replace(F.regexp_replace(col, r"\\.", ""), r'"[^"]*"', '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), F.lit(0))
    return F.array_distinct(F.transform(numbers, lambda n: F.coalesce(n.try_cast("bigint"), n.try_cast("double").try_cast("bigint"))))
