"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased; distance counts inserted, deleted and
replaced words. A document is contaminated by an item of L words if some stretch of it is within floor(0.2 L).

Edit distance becomes Hamming distance by a CGK walk: at every step the word under the pointer is written down, and a
random bit of (step, word) says whether the pointer moves on. Two near windows soon walk in step, so few of their
places differ. Bit-sampling LSH keeps ``SAMPLED`` places of a walk as a signature, again and again with new walks; how
often is found by trial for each class of item lengths (a power of two), until items with as many edits as allowed, of
each kind alone and of all kinds, are found with the target recall. A class that misses it within ``MOST_REPEATS`` walks (long
items of which words are only deleted) is verified exactly at every piece that occurs, without walks. Windows begin where a piece of an item occurs and a few words around: of floor(0.2 L) + 1
disjoint pieces an item has, one survives that many edits, so no true window is passed over, and all others, nearly all,
need no walk. What collides is verified by the exact distance (bit-parallel dynamic programming).

Documents don't move: items, at most ``BLOCK`` of them at a time, are sent to the tasks; more go in further rounds.

Defined cases: null texts are empty and contain nothing; items without an id, or of fewer than ``LEAST`` words, match
nothing; repeated items and repeated rows give rows each (an item id counts once per document id and text); other columns
are ignored; without items or documents the result is empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import ALNUM, Words, id_text, mix, slices

EDITS, LEAST, BLOCK = 0.2, 5, 20_000
CHUNK = 4 << 20
SAMPLED, RECALL, MOST_REPEATS, PIECE = 2, 0.99, 64, 4
#: Items must be found after edits of each of these kinds.
EDIT_KINDS = (("insert",), ("delete",), ("replace",), ("insert", "delete", "replace"))
_PAD = np.uint64(0x5EED)


def allowed(words: int, edits: float = EDITS) -> int:
    return int(edits * words + 1e-9)


def masks(pattern: list[int]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        out[word] |= 1 << i
    return dict(out)


def nearest(mask_of: dict[int, int], size: int, text: list[int], free: bool = True) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a stretch of ``text`` and where the first such ends.

    ``free``: the stretch may begin anywhere; else it begins at 0.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = size, 0
    for i, word in enumerate(text, 1):
        same = mask_of.get(word, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(h | up) & full, up & h
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | (not free), minus << 1
        up = (minus | ~(x | plus)) & full
        down = plus & x & full
        if score < best:
            best, end = score, i
    return best, end


def walk(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, steps: list[np.ndarray], salt: int) -> Iterator[tuple[int, np.ndarray]]:
    """(repeat, signature) of the windows that begin at ``start``; ``steps`` are the sampled places of each repeat."""
    for r, sampled in enumerate(steps):
        at = start.copy()
        out = np.full(len(start), np.uint64(salt * 1009 + r))
        for t in range(int(sampled[-1]) + 1):
            word = np.where(at < end, symbols[np.minimum(at, len(symbols) - 1)], _PAD)
            if t in sampled:
                out = mix(out * np.uint64(31) + word)
            at += (mix(word + np.uint64((salt * 4099 + r * 257 + t) * 2 + 1)) >> np.uint64(63)).astype(np.int64)
        yield r, out


class Index:
    """Items with the hashes of their words, their pieces, and signatures by class of length."""

    def __init__(self, ids: list, words: list[np.ndarray], edits: float = EDITS) -> None:
        kept = [i for i, w in enumerate(words) if ids[i] is not None and len(w) >= LEAST]
        self.ids, self.words = [ids[i] for i in kept], [words[i] for i in kept]
        self.masks = [masks(w.tolist()) for w in self.words]
        self.slack = [allowed(len(w), edits) for w in self.words]
        pieces: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        classes: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            n = self.slack[i] + 1
            for j in range(n):
                first, last = j * len(w) // n, (j + 1) * len(w) // n
                size = min(PIECE, last - first)
                pieces[size].append((int(grams(w[first : first + size], size)[0]), first, self.slack[i], i))
            classes[len(w).bit_length() - 1].append(i)
        # piece hashes of each size, sorted, with the place in the item, the item's slack and its number
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            self.pieces[size] = tuple(np.array(c, t) for c, t in zip(zip(*found), (np.uint64, np.int64, np.int64, np.int64)))
        self.tables = []
        self.exact = np.zeros(len(self.words), bool)
        for k, members in sorted(classes.items()):
            steps = self._steps(k, members)
            if steps is None:
                self.exact[members] = True
                continue
            text = np.concatenate([self.words[i] for i in members])
            end = np.cumsum([len(self.words[i]) for i in members])
            start = np.concatenate(([0], end[:-1]))
            signed = []
            for _, s in walk(text, start, end, steps, k):
                order = np.argsort(s, kind="stable")
                signed.append((s[order], np.array(members)[order]))
            self.tables.append((k, steps, signed))

    def _steps(self, k: int, members: list[int]) -> list[np.ndarray] | None:
        """Sampled places, with as many repeats as edited items of each kind need to be found; None if that is too many."""
        random = np.random.default_rng(k)
        length = max(1, 3 * (1 << k) // 2)
        steps = [np.sort(random.integers(0, length, SAMPLED)) for _ in range(MOST_REPEATS)]
        pick = [members[i] for i in random.integers(0, len(members), 200)]
        found = []
        plain = self._signatures([self.words[i] for i in pick], steps, k)
        for kinds in EDIT_KINDS:
            edited = self._signatures([_edited(self.words[i], self.slack[i], random, kinds) for i in pick], steps, k)
            found.append(np.stack([a == b for a, b in zip(plain, edited)]))
        for r in range(MOST_REPEATS):
            if all(f[: r + 1].any(axis=0).mean() >= RECALL for f in found):
                return steps[: r + 1]
        return None

    @staticmethod
    def _signatures(texts: list[np.ndarray], steps: list[np.ndarray], k: int) -> list[np.ndarray]:
        end = np.cumsum([len(t) for t in texts])
        return [s for _, s in walk(np.concatenate(texts), np.concatenate(([0], end[:-1])), end, steps, k)]

    def candidates(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window start, item) pairs whose signatures collide, and those of a piece and its item where walks don't do."""
        starts = [np.zeros(0, np.int64)]
        for size, (hashes, offset, slack, item) in self.pieces.items():
            if len(words.hash) < size:
                continue
            own = grams(words.hash, size)
            hit = np.flatnonzero(_member(hashes, own))
            if not len(hit):
                continue
            low, high = np.searchsorted(hashes, own[hit]), np.searchsorted(hashes, own[hit], "right")
            n = high - low
            piece = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = np.repeat(hit, n)
            place = at - offset[piece]
            exact = self.exact[item[piece]]
            if exact.any():
                yield np.maximum(place, words.first[words.of[at]])[exact], item[piece][exact]
                at, piece, place = at[~exact], piece[~exact], place[~exact]
                if not len(at):
                    continue
            widths = 2 * slack[piece] + 1
            shift = np.arange(widths.sum()) - np.repeat(np.concatenate(([0], np.cumsum(widths)[:-1])), widths)
            text = words.of[np.repeat(at, widths)]
            start = np.repeat(place - slack[piece], widths) + shift
            starts.append(np.maximum(start, words.first[text]))
        start = np.unique(np.concatenate(starts))
        start = start[(start >= 0) & (start < len(words.hash))]
        if not len(start):
            return
        end = words.first[words.of[start] + 1]
        for k, steps, signed in self.tables:
            for r, s in walk(words.hash, start, end, steps, k):
                hashes, items = signed[r]
                low, high = np.searchsorted(hashes, s), np.searchsorted(hashes, s, "right")
                n = high - low
                piece = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                yield np.repeat(start, n), items[piece]

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, word behind the last, distance): the nearest stretch for each text and item."""
        pairs = [np.zeros((0, 2), np.int64)]
        for start, item in self.candidates(words):
            pairs.append(np.unique(np.stack((start, item), 1), axis=0))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done = -1, -1
        for item, start in sorted((int(i), int(s)) for s, i in np.unique(np.concatenate(pairs), axis=0)):
            # neighbouring starts of an item read one stretch: go on behind what has been read
            of, size, slack = int(words.of[start]), len(self.words[item]), self.slack[item]
            first, last = int(words.first[of]), int(words.first[of + 1])
            if done[0] == item and start <= done[1] and start >= first:
                continue
            low, high = max(first, start - slack), min(last, start + size + 3 * slack + 1)
            done = item, start + slack
            distance, end = nearest(self.masks[item], size, words.hash[low:high].tolist())
            if distance > slack:
                continue
            back = words.hash[low : low + end][::-1].tolist()
            _, long = nearest(masks(self.words[item][::-1].tolist()), size, back, free=False)
            begin = low + end - long - first
            key, value = (of, item), (distance, begin, begin + long)
            if key not in best or value < best[key]:
                best[key] = value
        for (of, item), (distance, begin, end) in sorted(best.items()):
            yield of, item, begin, end, distance


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    out = hashes[: len(hashes) - size + 1].copy()
    for i in range(1, size):
        out = mix(out * np.uint64(31) + hashes[i : len(hashes) - size + 1 + i])
    return out


def _member(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` may be there: a bitmap of 22 bits of the hash turns nearly all others away."""
    bits = np.zeros(1 << 22, bool)
    bits[(sorted_hashes >> np.uint64(42)).astype(np.int64)] = True
    out = bits[(wanted >> np.uint64(42)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, wanted[at]), len(sorted_hashes) - 1)] == wanted[at]
    return out


def _edited(words: np.ndarray, n: int, random: np.random.Generator, kinds: tuple[str, ...]) -> np.ndarray:
    """The words after ``n`` edits of the given kinds, at random places."""
    out = words.tolist()
    for _ in range(n):
        at, kind = int(random.integers(0, len(out) + 1)), kinds[int(random.integers(0, len(kinds)))]
        if kind == "insert":
            out.insert(at, int(random.integers(1, 1 << 62)))
        elif len(out) > 1:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [] if kind == "delete" else [int(random.integers(1, 1 << 62))]
    return np.array(out, np.uint64)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start, end (words, end exclusive), distance, n_words: one row per document and item that it holds."""
    source = id_text(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema[item_col].dataType),
                           *[T.StructField(n, T.LongType()) for n in ("start", "end", "distance", "n_words")]])
    return reduce(DataFrame.unionAll, (_found(source, index, schema) for index in indexes(items, item_col, item_text_col, edits)))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          edits: float = EDITS) -> DataFrame:
    """The whole rows of ``docs`` that hold no item, filtered where they are read."""
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, index: Index) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at, CHUNK):
                    kept = np.ones(part.num_rows, bool)
                    kept[[f[0] for f in sent.value.matches(Words(pc.fill_null(part.column(at), ""), ALNUM))]] = False
                    yield part.filter(pa.array(kept))

        return rows.mapInArrow(run, rows.schema)

    return reduce(without, indexes(items, item_col, item_text_col, edits), docs)


def indexes(items: DataFrame, item_col: str, text_col: str, edits: float) -> list[Index]:
    """The items, in portions of about ``BLOCK``; one empty index if there are none."""
    wanted = id_text(items, item_col, text_col)
    rounds = max(1, -(-wanted.count() // BLOCK))
    dealt = wanted.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)))
    out = []
    for i in range(rounds):
        found = dealt.where(F.col("round") == i).select("doc_id", "text").toArrow().combine_chunks()
        texts = found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string())
        words = Words(texts, ALNUM)
        out.append(Index(found.column("doc_id").to_pylist(), [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(texts))], edits))
    return out


def _found(source: DataFrame, index: Index, schema: T.StructType) -> DataFrame:
    sent = source.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                found = list(sent.value.matches(Words(part.column(1), ALNUM)))
                if found:
                    ids = part.column(0).take(pa.array([f[0] for f in found]))
                    items_of = pa.array([sent.value.ids[f[1]] for f in found])
                    numbers = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids, items_of, *numbers, pa.array([len(sent.value.words[f[1]]) for f in found], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
