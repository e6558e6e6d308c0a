"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

A text's set holds the 64-bit hashes of its distinct word 5-grams. Texts with equal sets are one vertex (a digest of the
set). All tokens have one order: frequency level first (0: rare), then hash. Of a set of n tokens any partner shares at
least o = ceil(0.75 n), so two linked sets of different texts share at least K = 2 of their first n - o + K tokens in
that order (the extended prefix). Either a rare token is among them: rare tokens of the prefix are indexed alone. Or all
are frequent: then they share a pair of frequent tokens, and pairs are indexed. A set with more than ``PAIRS`` frequent
tokens in its prefix (a "wide" one) indexes them alone, and meets all other sets with frequent tokens in those lists,
which serve no pair of sets that aren't wide. So no link is lost whatever the levels are. They come from counts over
all texts and decide speed, not results.

A list of the index (the vertices of one signature) isn't expanded into pairs. First each vertex is compared with a
hub of its list: of those of similar size the one with the fewest rare tokens, which in a group of copies is the text they
were made from. The components of what holds leave the lists with several components open. Only their vertices may still
link, and only with each other. Two sets that share c tokens of their prefixes share at most c and the larger rest of the two,
which says how many a linked pair's prefixes must share; so a vertex in fewer open lists than that drops out with all its
pairs. Lists of a few members count the meetings of each pair. Of longer ones those that decide are expanded (see ``deciding``),
and only those pairs are made whose prefixes, compared inside the task, share enough, each in one of its lists. A pair that meets
in both kinds is counted in both. Only pairs that share enough are verified.

Verification reads the texts themselves and compares whole sets. Nothing is cut off: lists have no longest length.

Defined cases: a null text is an empty text; texts without words have the empty set and link with nothing; rows of
the same id are one vertex each for their sets, and the id stands for all of them; a row with a null id belongs to the
component of the set it shares with a row that has an id, and links with nothing else (its component is null); other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import SOLID, Words, id_text, kept_table, mix, slices

K, PAIRS, N = 2, 32, 5
#: A token is frequent if so many different texts hold it, and at most so many tokens are told to all tasks.
FREQUENT, LEVELS = 8, 1_000_000
#: Ids that may be sent to all tasks; beyond it the texts are joined by a shuffle.
SENT_IDS = 2_000_000
CHUNK = 4 << 20


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


def sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has its whole sequence as one."""
    words = Words(texts, SOLID)
    grams = words.hash.copy()
    for i in range(1, N):
        grams = mix(grams[: len(words.hash) - i] * np.uint64(31) + words.hash[i:]) if len(words.hash) > i else grams[:0]
    out = []
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        elif b > a:
            whole = hashlib.blake2b(b" ".join(words.text(j) for j in range(a, b)), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def vertex(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1, CHUNK):
            yield part, sets(part.column(batch.num_columns - 1))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and v (null without shingles) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets_of(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([vertex(s) if len(s) else None for s in found], pa.int64())],
                names=["doc_id", "n_shingles", "v"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("v", T.LongType())]))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """The vertices of a task with their sets, once each."""
    seen: set[int] = set()
    for _, found in _sets_of(batches):
        for tokens in found:
            if len(tokens) and (v := vertex(tokens)) not in seen:
                seen.add(v)
                yield v, tokens


def levels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, sorted, and their levels (log2 of how many texts hold them).

    A task counts the tokens of a few million at a time and passes on those it has seen twice; what it has seen once in
    every portion isn't frequent. At most ``LEVELS`` tokens are kept, those of the highest levels.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

        for _, tokens in _distinct(batches):
            held.append(tokens)
            size += len(tokens)
            if size >= 8_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    counts = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select(
        "token", F.floor(F.log2("n")).cast("int").alias("level"))
    counts = kept_table(counts)
    room, least = LEVELS, 64
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    found = counts.where(F.col("level") >= least).toArrow()
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("level").to_numpy()[order].astype(np.uint8)


#: Kinds of signatures, in their two lowest bits. Those of pairs have the pair's depth in the bits above: how many of their
#: lowest bits the two tokens have in common, at most ``DEPTH``.
RARE, PAIR, WIDE = 0, 1, 2
DEPTH = 7


def signatures(tokens: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, bool]:
    """The index entries of a set (rare tokens of its extended prefix, pairs of the frequent ones, and these for wide
    sets), and whether it is wide."""
    n = len(tokens)
    prefix = min(n, n - -(-3 * n // 4) + K)
    order = np.lexsort((tokens, level))[:prefix] if level.any() else np.arange(prefix)
    chosen, frequent = tokens[order], level[order] > 0
    common = np.sort(chosen[frequent])
    out = [(chosen[~frequent], RARE), (mix(common + np.uint64(0xB16)), WIDE)]
    wide = len(common) > PAIRS
    if not wide:
        i, j = np.triu_indices(len(common), 1)
        depth = sum(((common[i] ^ common[j]) & np.uint64((1 << k) - 1) == 0).astype(np.uint64) for k in range(1, DEPTH + 1))
        out.append((mix(common[i] * np.uint64(31) + common[j]) & ~np.uint64(31) | depth << np.uint64(2), PAIR))
    return np.concatenate([x & ~np.uint64(3) | np.uint64(kind) for x, kind in out]), wide


def lists(docs: DataFrame, levels_of: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sig, v, n, wide, hub, hub_n, hub_wide: the members of every list of two or more vertices and their hubs."""
    sent = docs.sparkSession.sparkContext.broadcast(levels_of)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level_of = sent.value
        held: list[tuple[np.ndarray, int, int, bool, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            lengths = [len(h[0]) for h in held]
            column = lambda i, kind: pa.array(np.repeat(np.array([h[i] for h in held], kind), lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), column(1, np.int64), column(2, np.int32), column(3, bool), column(4, np.int32)],
                names=["sig", "v", "n", "wide", "rare"])

        for v, tokens in _distinct(batches):
            level = np.zeros(len(tokens), np.uint8)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                hit = frequent[at] == tokens
                level[hit] = level_of[at[hit]]
            found, wide = signatures(tokens, level)
            held.append((found, v, len(tokens), wide, len(tokens) - int((level > 0).sum())))
            size += len(held[-1][0])
            if size >= 100_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by sig, rare, n, v; the rows of a list may reach over batches, so its first row waits for the next.
        sig = before = None
        alone = False
        hubs: list[list] = []  # of sizes that aren't similar to each other
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            s = columns[0]
            # most signatures are alone: only rows whose neighbour has the same one are looked at
            near = np.zeros(len(s), bool)
            near[1:] |= s[1:] == s[:-1]
            near[:-1] |= s[1:] == s[:-1]
            if len(s):
                near[0] = near[-1] = True
            for x, *member in zip(*(c[near].tolist() for c in columns)):
                if x != sig:
                    sig, hubs, alone = x, [member], True
                elif member[0] != before[0]:
                    if alone:
                        rows.append((sig, *before, *before))
                        alone = False
                    hub = next((h for h in hubs if 4 * h[1] >= 3 * member[1] and 4 * member[1] >= 3 * h[1]), None)
                    if hub is None:
                        hub = member
                        hubs.append(member)
                    rows.append((sig, *member, *hub))
                before = member
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["sig", "v", "n", "wide", "hub", "hub_n", "hub_wide"])

    entries = docs.mapInArrow(index, "sig long, v long, n int, wide boolean, rare int")
    return entries.repartition("sig").sortWithinPartitions("sig", "rare", "n", "v").mapInArrow(
        runs, "sig long, v long, n int, wide boolean, hub long, hub_n int, hub_wide boolean")


#: Members of a list up to which pairs of neighbours at each distance are made for all lists together.
FEW = 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of whole lists (rows come sorted by their first column) and where each list begins, with the end behind."""
    held: list[np.ndarray] | None = None

    def out(c: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        return c, np.concatenate(([0], np.flatnonzero(c[0][1:] != c[0][:-1]) + 1, [len(c[0])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield out([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None:
        yield out(held)


def least_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens of their extended prefixes two linked sets of x and y tokens share at least."""
    return -(-3 * (x + y) // 7) - np.maximum(-(-3 * x // 4), -(-3 * y // 4)) + K


def _could_link(c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which members i and j (sig, v, n, wide, label, met) lie in different components and share enough by size and ``met``."""
    sig, _, n, wide, label, met = c[:6]
    ok = (label[i] != label[j]) & (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i]) & (((sig[i] & 3) != WIDE) | wide[i] | wide[j])
    return ok & (least_shared(n[i], n[j]) <= np.minimum(met[i], met[j]))


def meeting(members: DataFrame) -> DataFrame:
    """Of ``members`` (sig, v, n, wide, label) those that could link with a member of their list from another component;
    ``need``: how many tokens of its prefix a member shares at least with one it links with; and ``met``: how many a vertex
    shares at most with any one from another component; ``size`` is that of the list.

    A linked pair shares ``least_shared`` tokens of its prefixes, and all of their lists hold two components. So a vertex that
    is in fewer such lists than any partner's size asks for goes; then others meet fewer, until that changes little (less than
    a quarter of the members go).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, start in _whole(batches):
            n, wide, met = c[2], c[3], c[5]
            need = np.full(len(n), np.iinfo(np.int64).max)
            sizes = np.diff(start)
            few = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
            for lag in range(1, FEW):
                at = np.flatnonzero(c[0][few[lag:]] == c[0][few[: len(few) - lag]])
                if not len(at):
                    break
                i, j = few[at], few[at + lag]
                ok = _could_link(c, i, j)
                i, j = i[ok], j[ok]
                shared = least_shared(n[i], n[j])
                np.minimum.at(need, i, shared)
                np.minimum.at(need, j, shared)
            for g in np.flatnonzero(sizes > FEW).tolist():
                low, high = int(start[g]), int(start[g + 1])
                if (c[4][low:high] == c[4][low]).all() or (c[0][low] & 3 == WIDE and not wide[low:high].any()):
                    continue
                # the less alike two sizes are, the fewer tokens are asked for (among larger ones up to one, by rounding)
                x = n[low:high]
                a, b = np.searchsorted(x, -(-3 * x // 4)), np.searchsorted(x, 4 * x // 3, "right") - 1
                need[low:high] = np.where(b > a, np.minimum(least_shared(x, x[a]), least_shared(x, x[b]) - 1), need[low:high])
            ok = need <= met
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (*c[:5], need, np.repeat(sizes, sizes))], names=["sig", "v", "n", "wide", "label", "need", "size"])

    now, before, kind = members.withColumn("met", F.col("n")), None, _kind(F.col("sig"))
    while True:
        rows = now.select("sig", "v", F.col("n").cast("long").alias("n"), "wide", "label", F.col("met").cast("long").alias("met"))
        left = kept_table(rows.repartition("sig").sortWithinPartitions("sig", "n", "v").mapInArrow(
            run, "sig long, v long, n long, wide boolean, label long, need long, size long"))
        met = left.groupBy("v").agg((F.count_if(kind == RARE) + F.greatest(_of_pairs(F.count_if(kind == PAIR)), F.count_if(kind == WIDE))).alias("met"))
        now = left.join(met, "v").where("need <= met")
        total = left.count()
        if before is not None and 4 * total >= 3 * before:
            return now
        before = total


def deciding(members: DataFrame) -> DataFrame:
    """Of ``members`` (sig, v, need, size, others) those whose lists have to be expanded: ``decides``.

    Two linked sets share a rare token, or as many frequent ones as the larger ``least`` of the two (a vertex's smallest need). Of
    so many tokens two agree in their lowest bits, if these have fewer values: so pairs of less depth are left out. Of single
    tokens in one order of lists, the shortest first, the last ones are left out, fewer than ``least``.
    """
    kind = _kind(F.col("sig"))
    last = Window.partitionBy("v", kind).orderBy(F.desc("size"), F.desc("sig")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = members.withColumns({"least": F.min("need").over(Window.partitionBy("v")), "last": F.count("*").over(last)})
    depth = F.shiftright("sig", 2).bitwiseAND(F.lit(7))
    bits = F.least(F.floor(F.log2(F.greatest(F.col("least") - 1, F.lit(1)))), F.lit(DEPTH))
    decides = F.when(kind == RARE, True).when(kind == PAIR, depth >= bits).otherwise(F.col("last") >= F.col("least"))
    return found.withColumn("decides", decides).drop("least", "last")


def _in_common(owner: np.ndarray, column: np.ndarray, low: int, high: int, members: int) -> np.ndarray:
    """How many columns the members from ``low`` to ``high`` share with each of all. ``owner``, ``column``: what each member has."""
    mine = np.unique(column[(owner >= low) & (owner < high)])
    total = np.zeros((high - low, members), np.float32)
    step = max(1, (8 << 20) // members)
    for first in range(0, len(mine), step):
        some = mine[first : first + step]
        at = np.minimum(np.searchsorted(some, column), len(some) - 1)
        here = some[at] == column
        has = np.zeros((members, len(some)), np.float32)
        has[owner[here], at[here]] = 1
        total += has[low:high] @ has.T
    return total.astype(np.int64)


def _shared(sigs: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The signatures that members i and j share: which pair, and the signature; about a million are looked up at a time."""
    whole = np.concatenate(sigs)
    values, flat = np.unique(whole, return_inverse=True)
    lengths = np.array([len(x) for x in sigs])
    first, many = np.cumsum(lengths) - lengths, len(values)
    keys = np.sort(np.repeat(np.arange(len(sigs)), lengths) * many + flat)
    ends = np.cumsum(lengths[i])
    low = 0
    while low < len(i):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - lengths[i[low]] + (1 << 20), "right")))
        own = lengths[i[low:high]]
        pair = np.repeat(np.arange(low, high), own)
        at = np.arange(len(pair)) + np.repeat(first[i[low:high]] - (np.cumsum(own) - own), own)
        asked = j[pair] * many + flat[at]
        hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        yield pair[hit], whole[at[hit]]
        low = high


def _in_common_of(sigs: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many signatures of each kind (rows) members i and j share, pair by pair."""
    total = np.zeros((3, len(i)), np.int64)
    for pair, sig in _shared(sigs, i, j):
        np.add.at(total, (sig & 3, pair), 1)
    return total


def meetings(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of lists of a few ``members`` (sig, v, n, wide, label, met, more_rare, more_pairs, more_alone) from different
    components that could link, once each: their sizes x and y, whether one is wide, how many signatures of each kind they share
    in these lists, and at most in others (``more_``).

    A row of a meeting doesn't grow with the two sets, however many lists they meet in.
    """
    more = ["more_rare", "more_pairs", "more_alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _ in _whole(batches):
            found = [np.zeros((2, 0), np.int64)]
            for lag in range(1, FEW):
                i = np.flatnonzero(c[0][lag:] == c[0][:-lag])
                if not len(i):
                    break
                i = i[_could_link(c, i, i + lag)]
                found.append(np.stack((i, i + lag)))
            i, j = np.concatenate(found, axis=1)
            if not len(i):
                continue
            _, v, n, wide, label = c[:5]
            i, j = np.where(label[i] < label[j], i, j), np.where(label[i] < label[j], j, i)
            order = np.lexsort((v[j], v[i]))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate(([True], (v[i][1:] != v[i][:-1]) | (v[j][1:] != v[j][:-1]))))
            shared = [np.add.reduceat((c[0][i] & 3 == kind).astype(np.int64), first) for kind in (RARE, PAIR, WIDE)]
            i, j = i[first], j[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (v[i], v[j], n[i], n[j], wide[i] | wide[j], *shared, *(np.minimum(x[i], x[j]) for x in c[6:]))],
                names=["a", "b", "x", "y", "wide", "rare", "pairs", "alone", *more])

    rows = members.select("sig", "v", "n", "wide", "label", "met", *more).repartition("sig").sortWithinPartitions("sig", "n", "v").mapInArrow(
        run, "a long, b long, x long, y long, wide boolean, rare long, pairs long, alone long, more_rare long, more_pairs long, more_alone long")
    return rows.groupBy("a", "b").agg(*[F.any_value(c).alias(c) for c in ("x", "y", "wide", *more)], *[F.sum(c).alias(c) for c in ("rare", "pairs", "alone")])


def across(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``members`` (sig, v, n, wide, label, need, met, size, decides) from different components that could link.

    Two that meet in a list of a few members are counted by their meetings there, and if that leaves them open by what they share
    in long lists, read once for the pair. Others meet in long lists only (see ``of_long_lists``).
    """
    kind, of, long_ = _kind(F.col("sig")), Window.partitionBy("v"), F.col("size") > FEW
    marked = members.withColumns({f"more_{name}": F.count_if(long_ & (kind == k)).over(of) for name, k in (("rare", RARE), ("pairs", PAIR), ("alone", WIDE))})
    rest = marked.where(long_)
    # Written, so that what is joined to the pairs later isn't joined to the meetings of each task.
    met = kept_table(meetings(marked.where(~long_)))
    sure = _enough()
    others = met.where(~sure & _enough("more_")).drop("more_rare", "more_pairs", "more_alone")
    a, b = (rest.groupBy(F.col("v").alias(x)).agg(F.collect_set("sig").alias(f"sigs_{x}")) for x in "ab")
    both = others.join(a, "a").join(b, "b").withColumn("both", F.array_intersect("sigs_a", "sigs_b")).drop("sigs_a", "sigs_b")
    also = lambda k: F.size(F.filter("both", lambda sig: _kind(sig) == k))
    both = both.withColumns({"rare": F.col("rare") + also(RARE), "pairs": F.col("pairs") + also(PAIR), "alone": F.col("alone") + also(WIDE)})
    in_long = rest.withColumn("met", F.col("more_rare") + F.greatest(_of_pairs(F.col("more_pairs")), F.col("more_alone"))).where("need <= met")
    return met.where(sure).select("a", "b").unionAll(both.where(_enough()).select("a", "b")).unionAll(of_long_lists(in_long)).distinct()


def of_long_lists(members: DataFrame) -> DataFrame:
    """The pairs (a, b) of lists of ``members`` (sig, v, n, wide, label, met, decides) that have to be expanded, from different
    components, that share enough in these lists alone.

    The signatures that two share are counted before a pair is made. Near copies meet in many lists, dealt over many tasks: a
    pair is made in that of the smallest signature alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def enough(c: list[np.ndarray], i: np.ndarray, j: np.ndarray, counts: Iterable[np.ndarray]) -> np.ndarray:
            """Which pairs share enough signatures."""
            n, wide = c[2:4]
            rare, pairs, alone = counts
            frequent = np.where(wide[i] | wide[j], alone, np.floor((1 + np.sqrt(1 + 8 * pairs)) / 2))
            return rare + frequent >= least_shared(n[i], n[j])

        def here(c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Which pairs meet in no expanded list of a smaller signature."""
            sig, wide = c[0], c[3]
            least = np.full(len(i), np.iinfo(np.int64).max)
            for pair, both in _shared([x[:own] for own, x in zip(c[6], c[7])], i, j):
                serves = ((both & 3) != WIDE) | wide[i[pair]] | wide[j[pair]]
                np.minimum.at(least, pair[serves], both[serves])
            return least == sig[i]

        def made(c: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            v, label = c[1], c[4]
            i, j = np.where(label[i] < label[j], i, j), np.where(label[i] < label[j], j, i)
            return pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(v[j])], names=["a", "b"])

        def of_short(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Pairs of neighbours at each distance, of all lists of a few members."""
            found = [np.zeros((2, 0), np.int64)]
            for lag in range(1, FEW):
                i = np.flatnonzero(c[0][lag:] == c[0][:-lag])
                if not len(i):
                    break
                i = i[_could_link(c, i, i + lag)]
                found.append(np.stack((i, i + lag)))
            i, j = np.concatenate(found, axis=1)
            for choose in (here, lambda c, i, j: enough(c, i, j, _in_common_of(c[7], i, j))):
                if len(i):
                    ok = choose(c, i, j)
                    i, j = i[ok], j[ok]
            if len(i):
                yield made(c, i, j)

        def of_long(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """A list's pairs, in blocks."""
            n, sigs = c[2], c[7]
            if (c[4] == c[4][0]).all():
                return
            flat, owner = np.concatenate(sigs), np.repeat(np.arange(len(n)), [len(x) for x in sigs])
            held_by = [(owner[flat & 3 == kind], flat[flat & 3 == kind]) for kind in (RARE, PAIR, WIDE)]
            block = min(512, max(1, (4 << 20) // len(n)))
            for low in range(0, len(n), block):
                high = min(low + block, len(n))
                i, j = np.nonzero(np.arange(len(n)) > np.arange(low, high)[:, None])
                at = i + low
                ok = _could_link(c, at, j)
                if not ok.any():
                    continue
                i, j, at = i[ok], j[ok], at[ok]
                ok = enough(c, at, j, [_in_common(*held, low, high, len(n))[i, j] for held in held_by])
                j, at = j[ok], at[ok]
                if len(at) and (ok := here(c, at, j)).any():
                    yield made(c, at[ok], j[ok])

        for c, start in _whole(batches):
            sizes = np.diff(start)
            few = np.repeat(sizes <= FEW, sizes)
            yield from of_short([x[few] for x in c])
            for g in np.flatnonzero(sizes > FEW).tolist():
                yield from of_long([x[start[g] : start[g + 1]] for x in c])

    of = Window.partitionBy("v")
    signed = lambda which: F.collect_list(F.when(which, F.col("sig"))).over(of)
    held = members.select("sig", "v", "n", "wide", "label", "met", "decides", F.count_if("decides").over(of).alias("own"),
                          F.concat(signed(F.col("decides")), signed(~F.col("decides"))).alias("sigs")).where("decides").drop("decides")
    return held.repartition("sig").sortWithinPartitions("sig", "n", "v").mapInArrow(run, "a long, b long")


def promising(met: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough signatures. ``met``: sig, a, a_n, a_wide, b, b_n, b_wide, a row per shared one."""
    kind, wide = _kind(F.col("sig")), F.col("a_wide") | F.col("b_wide")
    counted = met.where((kind != WIDE) | wide).groupBy("a", "b").agg(
        F.any_value("a_n").alias("x"), F.any_value("b_n").alias("y"), F.any_value(wide).alias("wide"),
        F.count_if(kind == RARE).alias("rare"), F.count_if(kind == PAIR).alias("pairs"), F.count_if(kind == WIDE).alias("alone"))
    return counted.where(_enough()).select("a", "b")


def _kind(sig: Column) -> Column:
    return sig.bitwiseAND(F.lit(3))


def _of_pairs(pairs: Column) -> Column:
    """c tokens make c (c - 1) / 2 pairs; without a pair there may be one token."""
    return F.floor((1 + F.sqrt(1 + 8 * pairs)) / 2)


def _enough(more: str | None = None) -> Column:
    """Whether sets of x and y tokens, wide or not, could link, that share so many signatures of each kind, and of columns that
    begin with ``more`` as many again."""
    rare, pairs, alone = (F.col(c) + F.col(f"{more}{c}") if more else F.col(c) for c in ("rare", "pairs", "alone"))
    frequent = F.when(F.col("wide"), alone).otherwise(_of_pairs(pairs))
    rest = F.greatest(F.ceil(3 * F.col("x") / 4), F.ceil(3 * F.col("y") / 4)) - K
    return rare + frequent + rest >= F.ceil(3 * (F.col("x") + F.col("y")) / 7)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (a, b); ``texts`` has v and text once each."""
    a, b = (texts.select(F.col("v").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for part in slices(batch, 2, CHUNK):
                kept = []
                for i, (x, text, other) in enumerate(zip(part.column(0).to_pylist(), part.column(2), sets(part.column(3)))):
                    if x != last:
                        last, own = x, sets(pa.array([text.as_py()]))[0]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if linked(common, len(own), len(other)):
                        kept.append(i)
                if kept:
                    yield part.take(pa.array(kept)).select(["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of an edge: alternating large and small stars until nothing changes.

    Every round writes its edges, one per vertex and round at most as many as before.
    """
    now = kept_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours point to the smallest of the neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a vertex and its smaller neighbours point to the smallest of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = kept_table(small)
        total = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total(after) == total(now):
            break
        now = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionAll(now.select("b", "b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    source = id_text(docs, id_col, text_col)
    rows = kept_table(described(source))
    found = kept_table(lists(source, levels(source)))
    first = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("doc_id"))
    tried = kept_table(promising(found.where("v <> hub").selectExpr(
        "sig", "hub AS a", "hub_n AS a_n", "hub_wide AS a_wide", "v AS b", "n AS b_n", "wide AS b_wide")))
    near = kept_table(verified(tried, _texts_of(tried, first, source)))
    labels = components(near)
    # Lists that still hold several components: pairs across them that could link and haven't been tried.
    marked = found.join(labels, "v", "left").select("sig", "v", "n", "wide", F.coalesce("label", "v").alias("label"))
    open_ = kept_table(meeting(marked))
    pairs = across(deciding(open_))
    pairs = kept_table(pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    final = components(near.unionAll(verified(pairs, _texts_of(pairs, first, source))))
    named = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("doc_id").alias("low")).join(final, "v", "left").select(
        "v", "low", F.coalesce("label", "v").alias("label"))
    smallest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of = named.join(smallest, "label").select("v", "component_id")
    return rows.join(of, "v", "left").select("doc_id", "n_shingles", F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _texts_of(pairs: DataFrame, first: DataFrame, source: DataFrame) -> DataFrame:
    """v and text of every vertex of ``pairs``."""
    return _texts(pairs.select(F.col("a").alias("v")).unionAll(pairs.select("b")).distinct(), first, source)


def _texts(vertices: DataFrame, first: DataFrame, source: DataFrame) -> DataFrame:
    """v and text of every vertex. Ids go to all tasks if they are few enough, else the texts are shuffled."""
    wanted = kept_table(vertices.join(first, "v").where(F.col("doc_id").isNotNull()))
    return _one_text(source.join(F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted, "doc_id"))


def _one_text(candidates: DataFrame) -> DataFrame:
    """v and text: rows of an id that stands for a vertex, those whose own set is that vertex, once each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _sets_of(batches):
            own = [i for i, (v, s) in enumerate(zip(part.column(0).to_pylist(), found)) if len(s) and vertex(s) == v]
            if own:
                yield part.take(pa.array(own))

    return candidates.select("v", "text").mapInArrow(run, "v long, text string").dropDuplicates(["v"])
