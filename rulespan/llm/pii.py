"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the tokens (runs without white space) that hold a digit or an at sign; all other tokens are fixed to "none", so
they cut the chain and only lend context. Labels are none, email, ip, card, phone. Potentials: features of a token and
its context; neighbouring nodes; and skip edges that join a node to the next one with the same token and to the next one
of a similar token (the same shape with digits folded), however far away. A group of k equal tokens has k - 1 edges.
Loopy sum-product message passing over all nodes of some texts at once, until messages settle, gives each node's
marginals, so the occurrences of a token agree however many there are; a node that is sure of a label gives a span unless a base span touches it.

Weights are learnt by pseudo-likelihood from what the base patterns mark in a sample of at most ``BOUND`` texts: the
labels of a node's neighbours are features of the node, so that all potentials come from one softmax regression.

Base spans are exact: the patterns are searched leftmost and without overlap, per kind, in time linear in the text.

Defined cases: a null text is an empty text and has no spans; repeated rows are judged each alone; a null id stays
null; other columns are ignored; a table without any candidate trains nothing and gets base spans only; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import bounded_sample, id_text, slices
from rulespan.llm.spans import Span, clear, scan_spans, taken

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
BOUND, SURE = 3_000, 0.9
#: Messages run until none changes by more than this (log scale); fields that never settle end after so many rounds.
SETTLED, MOST_ROUNDS = 1e-7, 2_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOLID = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    """However many zeros it begins with."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """Around each at sign: the run of name characters before it, not before the last match's end, and the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield "email", start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    if not _CANDIDATE.search(text):
        return []
    found: list[Span] = list(_emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


@dataclass
class Nodes:
    """Nodes of one or more texts: token spans, feature numbers, and edges (from, to) of chain, same and similar."""

    text: list[int]
    span: list[tuple[int, int]]
    features: list[list[int]]
    edges: list[list[tuple[int, int]]]


#: Feature numbers: hashed token features, then the labels of the neighbours by edge kind and direction.
HASHED, PER_NODE = 2048, 9


def _number(name: str) -> int:
    return zlib.crc32(name.encode()) % HASHED


def shape(token: str) -> str:
    """Digits as 0, letters as a or A, repeats of a letter class once; digit runs keep their length."""
    token = re.sub("[^\\W\\d_]+", lambda m: "A" if m[0].isupper() else "a", token)
    return re.sub("[0-9]", "0", token)


def nodes(texts: list[str]) -> Nodes:
    out = Nodes([], [], [], [[], [], []])
    for of, text in enumerate(texts):
        if not _CANDIDATE.search(text):
            continue
        last_same: dict[str, int] = {}
        last_like: dict[str, int] = {}
        tokens = [m.span() for m in _SOLID.finditer(text)]
        before = -2
        for k, (start, end) in enumerate(tokens):
            if not _CANDIDATE.search(text, start, end):
                continue
            token, i = text[start:end], len(out.text)
            bare = token.strip(".,;:!?\"'|#%&*$<>[]{}=")
            kind = shape(bare)
            near = [text[slice(*tokens[j])] if 0 <= j < len(tokens) else "" for j in (k - 1, k + 1)]
            digits = sum("0" <= c <= "9" for c in bare)
            out.text.append(of)
            out.span.append((start, end))
            out.features.append([_number(f) for f in (
                "bias", f"shape {kind}", f"digits {min(digits, 24)}", f"letters {min(sum(c.isalpha() for c in bare), 12)}",
                f"dots {bare.count('.')}", f"marks {'@' in bare}{bare[:1] == '+'}{'(' in bare}{'-' in bare}",
                f"before {shape(near[0]) if _CANDIDATE.search(near[0]) else near[0][-1:]}",
                f"behind {shape(near[1]) if _CANDIDATE.search(near[1]) else ''}", f"only digits {digits == len(bare)}")])
            if before == k - 1:
                out.edges[0].append((i - 1, i))
            before = k
            for last, key, edge in ((last_same, bare, 1), (last_like, kind, 2)):
                if key and key in last and not (edge == 2 and last_same_at == last[key]):
                    out.edges[edge].append((last[key], i))
                if edge == 1:
                    last_same_at = last.get(key, -1)
                last[key] = i
    return out


def labels(found: Nodes, texts: list[str]) -> list[int]:
    """The label of each node by the base patterns."""
    spans = {t: sorted((s, e, KINDS.index(k) + 1) for k, s, e in base_spans(texts[t])) for t in set(found.text)}
    out, at, own = [], 0, None
    for t, (start, end) in zip(found.text, found.span):
        if own != t:
            own, at, reach = t, 0, []
        while at < len(spans[t]) and spans[t][at][0] < end:
            reach.append(spans[t][at])
            at += 1
        reach = [r for r in reach if r[1] > start]
        out.append(reach[0][2] if reach else 0)
    return out


@dataclass
class Field:
    unary: np.ndarray  # (HASHED, label)
    pair: np.ndarray  # (edge kind, label of the first, label of the second)


def train(features: np.ndarray, label: np.ndarray, edges: list[np.ndarray], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum pseudo-likelihood by gradient descent with momentum."""
    n = len(label)
    weights = np.zeros((HASHED + 2 * 3 * LABELS, LABELS))
    columns = [(np.repeat(np.arange(n), features.shape[1]), features.ravel())]
    for kind, e in enumerate(edges):
        if len(e):
            columns.append((e[:, 1], HASHED + (2 * kind) * LABELS + label[e[:, 0]]))
            columns.append((e[:, 0], HASHED + (2 * kind + 1) * LABELS + label[e[:, 1]]))
    node, feature = np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])
    speed = np.zeros_like(weights)
    target = np.eye(LABELS)[label]
    for _ in range(steps):
        scores = np.zeros((n, LABELS))
        np.add.at(scores, node, weights[feature])
        error = _softmax(scores) - target
        slope = np.zeros_like(weights)
        np.add.at(slope, feature, error[node])
        speed = 0.9 * speed - rate * (slope / n + decay * weights)
        weights += speed
    pair = weights[HASHED:].reshape(3, 2, LABELS, LABELS)
    # A pair's potential was seen from both ends.
    return Field(weights[:HASHED], (pair[:, 0] + pair[:, 1].transpose(0, 2, 1)) / 2)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def marginals(field: Field, found: Nodes, most: int = MOST_ROUNDS, settled: float = SETTLED) -> np.ndarray:
    """Each node's label probabilities after damped sum-product messages along all edges, until they settle.

    An edge whose messages and those it depends on have settled is left out of the next rounds, so a long chain of equal tokens
    in one text doesn't hold up the others.
    """
    unary = field.unary[np.array(found.features).reshape(-1, PER_NODE)].sum(axis=1)
    ends = [np.array(e, np.int64).reshape(-1, 2) for e in found.edges]
    pair = np.concatenate([np.repeat(field.pair[k][None], len(e), axis=0) for k, e in enumerate(ends)])
    a, b = np.concatenate(ends).T
    source, target = np.concatenate((a, b)), np.concatenate((b, a))
    pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    message = np.zeros((len(source), LABELS))
    belief = unary.copy()
    active = np.arange(len(source))
    for _ in range(most):
        if not len(active):
            break
        inner = (belief[source[active]] - message[back[active]])[:, :, None] + pair[active]
        high = inner.max(axis=1, keepdims=True)
        new = (high + np.log(np.exp(inner - high).sum(axis=1, keepdims=True)))[:, 0]
        step = 0.5 * (new - new.max(axis=1, keepdims=True) - message[active])
        message[active] += step
        np.add.at(belief, target[active], step)
        # a changed message concerns what its target sends on, and itself, since steps are halves
        moved = active[np.abs(step).max(axis=1, initial=0) > settled]
        touched = np.zeros(len(unary), bool)
        touched[target[moved]] = True
        again = touched[source]
        again[moved] = True
        active = np.flatnonzero(again)
    belief = unary.copy()
    np.add.at(belief, target, message)
    return _softmax(belief)


def added_spans(field: Field, texts: list[str], base: list[list[Span]], sure: float = SURE) -> list[list[Span]]:
    found = nodes(texts)
    out: list[list[Span]] = [[] for _ in texts]
    if not found.text:
        return out
    likely = marginals(field, found)
    label, p = likely.argmax(axis=1), likely.max(axis=1)
    chained = {b for _, b in found.edges[0]}
    last = None
    for i, (t, (start, end)) in enumerate(zip(found.text, found.span)):
        if not label[i] or p[i] < sure:
            last = None
            continue
        token = texts[t][start:end]
        core = token.strip(".,;:!?\"'|#%&*$<>[]{}=")
        start += token.index(core)
        end = start + len(core)
        kind = KINDS[label[i] - 1]
        if last == (t, kind) and i in chained:
            out[t][-1] = (kind, out[t][-1][1], end)
        else:
            out[t].append((kind, start, end))
        last = t, kind
    covered = [taken(b) for b in base]
    return [[s for s in spans if s[1] < s[2] and clear(s, covered[t])] for t, spans in enumerate(out)]


def learn(docs: DataFrame, bound: int = BOUND) -> Field | None:
    """Weights from a sample of texts that hold candidates; None without any."""
    holding = docs.where(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                texts = part.column(0).to_pylist()
                found = nodes(texts)
                edges = [pa.array([v for e in k for v in e], pa.int32()) for k in found.edges]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([labels(found, texts)], pa.list_(pa.int32())), pa.array([[f for row in found.features for f in row]], pa.list_(pa.int32())),
                     *(pa.array([e], pa.list_(pa.int32())) for e in edges)], names=["label", "features", "chain", "same", "like"])

    # Hashes of at most ``bound`` texts are fetched, then those texts' nodes.
    sample = bounded_sample(holding, F.col("doc_id"), bound).select("text")
    table = sample.mapInArrow(run, "label array<int>, features array<int>, chain array<int>, same array<int>, like array<int>").toArrow().to_pylist()
    label, features, edges, at = [], [], [[], [], []], 0
    for r in sorted(table, key=lambda r: r["features"]):
        label += r["label"]
        features += r["features"]
        for k, name in enumerate(("chain", "same", "like")):
            edges[k] += [v + at for v in r[name]]
        at = len(label)
    if not label:
        return None
    return train(np.array(features).reshape(-1, PER_NODE), np.array(label), [np.array(e, np.int64).reshape(-1, 2) for e in edges])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BOUND) -> DataFrame:
    """doc_id, base and added spans, counts of base kinds, base digest and all spans, per row."""
    field = learn(id_text(docs, id_col, text_col), bound)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def find(texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        base = [base_spans(t) for t in texts]
        added = added_spans(sent.value, texts, base) if sent.value is not None else [[] for _ in texts]
        return zip(base, added)

    return scan_spans(docs, id_col, text_col, KINDS, find)
