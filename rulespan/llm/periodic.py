"""Periodic runs of words, by a suffix automaton whose suffix links are kept in a link-cut forest.

A run is a stretch of words with smallest period q and at least ``LEAST`` words and ``TIMES`` * q words, which no
neighbouring word extends. Words are appended to the automaton one by one. The states on the way from a new prefix to
the root are the suffixes read so far; the colour of a state is the place where it last ended. Appending a word gives
the whole way the new place: the link-cut access walks it by segments of one colour, of which there are few. A segment
whose longest suffix has l words and last ended d words ago is a repetition of l + d words with period d, a square
where l >= d; no shorter period fits, since the last end is the nearest one. Enough repetition makes a run, which is
extended word by word to both sides. A run that reaches from s to e shows at e with its l + d words at the latest.

Before that, stretches that can't hold a run are left out: inside a run each ``GRAM`` words in a row stood at most a
period earlier. So a run with a period of at most D, and above half of it, lies in a stretch where this holds for D as
often as the run is long, widened by D. Only those stretches, merged, go through the automaton, whole however long they
are; the words around them take part in the extension. Hashes decide the stretches, which may only widen them; the
automaton and the extension compare words.

Defined cases: a null or empty text has no words and no run, its collapsed text is empty; runs that overlap each drop
their own words; repeated rows and null ids are rows like others; other columns are ignored; an empty table gives an
empty table. Time in one text is n log n up to logarithms, memory that of its stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulespan.llm.common import SOLID, Words, id_text, mix, slices

LEAST, TIMES, GRAM = 6, 4, 4
CHUNK = 4 << 20


def needed(period: int, least: int, times: int) -> int:
    """Words of a run with this period, at least."""
    return max(least, times * period)


def repetitions(ids: list[int], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(end, period, length): repetitions long enough for a run, as seen while words are appended; end is exclusive.

    State 1 is the automaton's root. ``left``, ``right`` and ``up`` are the splay trees of the link-cut forest, one for
    each way of one colour, ordered by depth; ``up`` of a tree's root is the state that the way hangs from. Only a
    tree's root carries the colour.
    """
    size = 2 * len(ids) + 2
    follow: list[dict[int, int]] = [{}, {}]
    link, longest = [0, 0], [0, 0]
    left, right, up, colour = [0] * size, [0] * size, [0] * size, [0] * size

    def splay(x: int) -> None:
        top = 0
        while True:
            p = up[x]
            if not p:
                break
            if left[p] == x:
                x_left = True
            elif right[p] == x:
                x_left = False
            else:
                break
            g = up[p]
            top = p
            if g:
                p_left = left[g] == p
                if p_left or right[g] == p:
                    top = g
                    if p_left == x_left:
                        # the parent goes first, then the node
                        if p_left:
                            b = left[g] = right[p]
                            right[p] = g
                        else:
                            b = right[g] = left[p]
                            left[p] = g
                        if b:
                            up[b] = g
                        above = up[g]
                        up[g] = p
                    else:
                        if x_left:
                            b = left[p] = right[x]
                            right[x] = p
                        else:
                            b = right[p] = left[x]
                            left[x] = p
                        if b:
                            up[b] = p
                        up[p] = x
                        above = up[g]
                        p, x_left = g, p_left
                        # the node takes its parent's place under g
                    if above:
                        if left[above] == g:
                            left[above] = x
                        elif right[above] == g:
                            right[above] = x
                    if x_left:
                        b = left[p] = right[x]
                        right[x] = p
                    else:
                        b = right[p] = left[x]
                        left[x] = p
                    if b:
                        up[b] = p
                    up[p] = x
                    up[x] = above
                    continue
            if x_left:
                b = left[p] = right[x]
                right[x] = p
            else:
                b = right[p] = left[x]
                left[x] = p
            if b:
                up[b] = p
            up[p] = x
            up[x] = g
        if top:
            colour[x] = colour[top]

    last = 1
    for end, word in enumerate(ids, 1):
        state = len(follow)
        follow.append({})
        longest.append(end)
        link.append(1)
        p = last
        while p and word not in follow[p]:
            follow[p][word] = state
            p = link[p]
        if p:
            q = follow[p][word]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                # The copy comes between q and its parent: q's way is cut above q, and all parts keep its colour.
                splay(q)
                above = left[q]
                if above:
                    up[above], left[q] = up[q], 0
                    colour[above] = colour[q]
                up[copy], colour[copy] = link[q], colour[q]
                up[q] = link[q] = link[state] = copy
                while p and follow[p].get(word) == q:
                    follow[p][word] = copy
                    p = link[p]
        up[state] = link[state]
        last = state
        # Access: the way from the new state to the root gets the colour ``end``.
        below, x = 0, state
        while x:
            if up[x]:
                splay(x)
            was, deeper = colour[x], right[x]
            if deeper:
                colour[deeper] = was
            right[x] = below
            if was:
                period = end - was
                length = longest[x] + period
                if length >= times * period and length >= least:
                    yield end, period, length
            below, x = x, up[x]
        colour[below] = end


def stretches(words: Words, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int]]]:
    """For each text that may hold runs: word ranges (from its first word, end exclusive) that hold them whole."""
    n = len(words.hash)
    gram = min(GRAM, *(needed(q, least, times) - q for q in range(1, least + 1)))
    if n < least:
        return {}
    key = words.hash + mix(words.of.astype(np.uint64) + np.uint64(1))
    start = key[: n - gram + 1].copy()
    for i in range(1, gram):
        start = mix(start * np.uint64(31) + key[i : n - gram + 1 + i])
    whole = words.of[: n - gram + 1] == words.of[gram - 1 :]
    order = np.argsort(start, kind="stable")
    same = np.flatnonzero(start[order[1:]] == start[order[:-1]])
    back = np.full(len(start), n, np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    back[~whole] = n
    first, stop = words.first[:-1], words.first[1:]
    found = []
    d, most = 1, int(np.max(stop - first)) // times
    while d < 2 * most:
        near = np.concatenate(([False], back <= d, [False]))
        edge = np.flatnonzero(near[1:] != near[:-1])
        a, b = edge[::2], edge[1::2]
        # two texts may follow each other in one stretch only if both are near throughout: their grams are apart
        smallest = d // 2 + 1
        long = b - a >= needed(smallest, least, times) - smallest - gram + 1
        a, b = a[long], b[long]
        of = words.of[a]
        found.append(np.stack([of, np.maximum(a - d, first[of]), np.minimum(b + gram - 1, stop[of])]))
        d *= 2
    if not found:
        return {}
    of, a, b = np.concatenate(found, axis=1)
    out: dict[int, list[tuple[int, int]]] = {}
    for i in np.lexsort((b, a)).tolist():
        text, low, high = int(of[i]), int(a[i] - first[of[i]]), int(b[i] - first[of[i]])
        ranges = out.setdefault(text, [])
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], high))
        else:
            ranges.append((low, high))
    return out


def runs_of(words: list[bytes], ranges: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that touch ``ranges``, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for low, high in ranges:
        ids: dict[bytes, int] = {}
        known: dict[int, tuple[int, int]] = {}
        for end, period, length in repetitions([ids.setdefault(w, len(ids)) for w in words[low:high]], least, times):
            a, b = low + end - length, low + end
            if period in known and known[period][0] <= a and b <= known[period][1]:
                continue
            while a and words[a - 1] == words[a - 1 + period]:
                a -= 1
            while b < len(words) and words[b] == words[b - period]:
                b += 1
            known[period] = a, b
            found.add((a, b - a, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run drops, joined by spaces: a run keeps its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every row.

    ``times`` is 2 or more and ``least`` 2 or more.
    """
    source = id_text(docs, id_col, text_col)
    run_type = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([source.schema["doc_id"], T.StructField("runs", T.ArrayType(run_type)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                ranges = stretches(Words(part.column(1), SOLID, lower=False), least, times)
                runs, kept = [], []
                for i, text in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
                    words = text.split()
                    own = runs_of(words, ranges[i], least, times) if i in ranges else []
                    runs.append([{"start": a, "length": n, "period": p} for a, n, p in own])
                    kept.append(collapsed(words, own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
