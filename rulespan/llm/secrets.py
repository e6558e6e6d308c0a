"""Secret scans: base patterns, and strings of high entropy.

Candidate strings are runs of letters, digits and ``+/_-=`` of at least ``SHORTEST`` characters. A window slides over a
candidate, counts of its characters are kept up to date by one step in and one step out, and so is the sum of
``c log2 c`` that Shannon entropy needs. Every window belongs to the smallest character class that holds it (hex,
base 36, letters of one case, letters, base 64), each with its own threshold; windows above it join to spans. A candidate
shorter than a window is one window, and must hold both cases and digits, with a threshold near the most its length allows.
Of a span that base spans cover in part the rest stays, if it is long enough. The allow list suppresses candidates that are
numbers, repeated sequences, identifiers with a dash pattern, words in parts, or paths.

Defined cases: a null text is an empty text and has no spans; repeated rows are judged each alone; a null id stays
null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from rulespan.llm.spans import Span, outside, scan_spans, taken

KINDS = ("assign", "access", "hex", "entropy")
WINDOW, SHORTEST = 20, 12
#: Bits per character that a window of each class must reach; letters alone are words more often than keys.
THRESHOLDS = {"hex": 3.0, "base36": 3.55, "base64": 3.75, "case": 3.85, "letters": 3.95}
#: The share of log2(length) that a candidate shorter than a window must reach.
SHORT_SHARE = 0.95

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)

#: Candidates that hold no secret.
ALLOWED = [
    re.compile(r"(?:[A-Za-z]{0,19}[_=+/-]++)*+[A-Za-z]{0,19}\Z"),  # words, rulers, paths of words
    re.compile(r"[0-9_=+/-]*\Z"),  # numbers, dates, phone numbers
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),  # universally unique ids
    re.compile(r"(.{1,8}?)\1+.{0,8}\Z"),  # one short piece again and again
    re.compile(r"(?:/[A-Za-z]+[0-9]{0,4})+/?\Z"),  # paths
    re.compile(r"(?:[A-Za-z]+[0-9]{0,4}[-_])+[A-Za-z]*[0-9]{0,4}\Z"),  # names in parts
]
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_HEX_SET = frozenset("0123456789abcdefABCDEF")


def windows(text: str, size: int = WINDOW) -> Iterator[tuple[int, str, float]]:
    """(start, class, entropy in bits) of each window, from counts kept up to date."""
    counts: dict[str, int] = {}
    total, lower, upper, digits, marks, beyond_hex = 0.0, 0, 0, 0, 0, 0
    log = math.log2(size)
    for i, c in enumerate(text):
        for x, by in ((c, 1), (text[i - size], -1)) if i >= size else ((c, 1),):
            n = counts.get(x, 0)
            total += _TERM[n + by] - _TERM[n]
            counts[x] = n + by
            if "a" <= x <= "z":
                lower += by
            elif "A" <= x <= "Z":
                upper += by
            elif "0" <= x <= "9":
                digits += by
            else:
                marks += by
            beyond_hex += by * (x not in _HEX_SET)
        if i >= size - 1 and lower + upper:
            one_case = not (lower and upper) and not marks
            if digits:
                kind = "hex" if one_case and not beyond_hex else "base36" if one_case else "base64"
            elif marks:
                continue
            else:
                kind = "case" if one_case else "letters"
            yield i - size + 1, kind, log - total / size


def entropy_spans(text: str, thresholds: dict[str, float] = THRESHOLDS) -> list[Span]:
    spans: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        if any(a.match(m[0]) for a in ALLOWED):
            continue
        n = m.end() - m.start()
        if n < WINDOW:
            _, kind, bits = next(windows(m[0], n), (0, "", 0.0))
            mixed = any("a" <= c <= "z" for c in m[0]) and any("A" <= c <= "Z" for c in m[0])
            if kind == "base64" and mixed and bits >= SHORT_SHARE * math.log2(n):
                spans.append(("entropy", *m.span()))
            continue
        start = end = -1
        for at, kind, bits in windows(m[0]):
            if bits >= thresholds[kind]:
                if end >= at:
                    end = at + WINDOW
                    continue
                if end >= 0:
                    spans.append(("entropy", m.start() + start, m.start() + end))
                start, end = at, at + WINDOW
        if end >= 0:
            spans.append(("entropy", m.start() + start, m.start() + end))
    return spans


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def find(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    for text in texts:
        base = base_spans(text)
        covered = taken(base)
        yield base, [part for s in entropy_spans(text) for part in outside(s, covered, SHORTEST)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added spans, counts of base kinds, base digest and all spans, per row."""
    return scan_spans(docs, id_col, text_col, KINDS, find, own_kinds=("entropy",))
