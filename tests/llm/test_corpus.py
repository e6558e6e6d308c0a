"""Joins, dedup, packing, search, classifiers and the pipeline against brute force, and their defined edge cases."""

import re
import tracemalloc
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from oracle import connect, duck_table, spark_table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulespan.llm import decontaminate, linededup, nbsvm, ngramjoin, packing, quality, topk, toxicity
from rulespan.llm.common import ALNUM, SOLID, Words
from rulespan.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
PACK = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS v", "text AS chunk", "doc_id AS length", "text AS `row`", "doc_id AS id")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def components(rows):
    """doc_id -> (set size, smallest id reachable), by counting shared shingles of all pairs that share one."""
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    having, shared, root = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            for j in having[g]:
                shared[j, i] += 1
            having[g].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_words_equal_a_plain_split():
    texts = ["", "Ab c\td", "é É x", "  ", "a" * 50, "one\nTWO three"]
    for kind, pattern in ((SOLID, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts), kind)
        for i, t in enumerate(texts):
            assert [w.text(j).decode() for j in range(w.first[i], w.first[i + 1])] == re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t))


def test_ngram_join_on_the_tables(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_ngram_join"](spark, DATA).collect()}
    assert got == components(documents(spark))


def test_ngram_join_of_hot_groups(spark, monkeypatch):
    """Many near copies, a passage that many share, copies, short and empty texts; frequent from two texts on."""
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    monkeypatch.setattr(ngramjoin, "PAIRS", 6)
    random = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: list(random.choice(vocabulary, n))
    rows, base, passage = [], text(60), text(40)
    for i in range(80):
        t = list(base)
        for _ in range(int(random.integers(0, 5))):
            t[int(random.integers(0, len(t)))] = "new" + str(random.integers(0, 99))
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(text(5 + i % 9) + passage + text(i % 5))) for i in range(60)]
    rows += [(200 + i, "same short") for i in range(5)] + [(210, ""), (211, None), (212, "one"), (213, "ONE"), (214, "a b c d e"), (215, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == components(rows)


@pytest.mark.parametrize("few", [2, 16])
def test_ngram_join_of_copies_at_all_distances(spark, monkeypatch, few):
    """Families whose copies lie on both sides of the similarity, from their centre and from each other, with edits that several
    copies share; so that many links join copies that miss the centre."""
    monkeypatch.setattr(ngramjoin, "FEW", few)
    random = np.random.default_rng(few)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for family in range(3):
        base = list(random.choice(vocabulary, 70 + 10 * family))
        centres = [base]
        for _ in range(2):
            other = list(base)
            for at in sorted(random.choice(len(base) - 8, 2 + family, replace=False).tolist(), reverse=True):
                other[at : at + 3] = list(random.choice(vocabulary, 3))
            centres.append(other)
        for _ in range(90):
            t = list(centres[int(random.integers(3))])
            for _ in range(int(random.integers(0, 6))):
                at = int(random.integers(len(t) // 5)) * 5
                kind = int(random.integers(3))
                t[at : at + (kind != 1)] = [] if kind == 0 else [f"x{int(random.integers(3))}"]
            rows.append((len(rows), " ".join(t)))
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows).repartition(3)).collect()}
    assert got == want
    assert 3 < len({c for _, c in want.values()}) < 200


def test_ngram_join_reads_no_texts_that_only_share_a_passage(spark, monkeypatch):
    """Texts that share a few shingles, in pairs or all of them, stay in open lists but can't link."""
    read, texts = [], ngramjoin._texts
    monkeypatch.setattr(ngramjoin, "_texts", lambda vertices, *rest: read.append(vertices.count()) or texts(vertices, *rest))
    rows = []
    for i in range(60):
        own = [f"w{i}x{j}" for j in range(100)]
        rows.append((i, " ".join(own + [f"p{i // 2}x{j}" for j in range(7)] + [f"all{j}" for j in range(8)])))
    got = {r.doc_id: r.component_id for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == {i: i for i in range(60)} and sum(read) == 0


def test_ngram_join_makes_only_pairs_that_share_enough(spark, monkeypatch):
    """Near copies below the similarity: of their lists, that all of them share, no pair leaves the task."""
    made, across = [], ngramjoin.across
    monkeypatch.setattr(ngramjoin, "across", lambda *given: made.append(across(*given).count()) or across(*given))
    random = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        t = list(base)
        for at in sorted(random.choice(24, 6, replace=False).tolist()):
            t[at * 5] = f"e{at}x{i % 7}"
        rows.append((i, " ".join(t)))
    want = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 30 and sum(made) < 60 * 59 / 2 / 5


def test_ngram_join_makes_no_pairs_of_many_short_lists_that_share_too_little(spark, monkeypatch):
    """49 texts as the points of a plane, each of its 56 lines a passage of seven texts: all texts meet, each two in one passage."""
    made, across = [], ngramjoin.across
    monkeypatch.setattr(ngramjoin, "across", lambda *given: made.append(across(*given).count()) or across(*given))
    rows = []
    for x in range(7):
        for y in range(7):
            lines = [f"m{m}c{(y - m * x) % 7}" for m in range(7)] + [f"x{x}"]
            rows.append((7 * x + y, " ".join(f"{line}w{k}" for line in lines for k in range(20))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows)).collect()}
    assert got == components(rows) == {i: (156, i) for i in range(49)} and sum(made) < 49


def test_ngram_join_makes_a_pair_in_one_list_only(spark, monkeypatch):
    """Two texts meet in many lists, dealt over many tasks: no pair leaves two of them."""
    made, across = [], ngramjoin.across

    def counted(*given):
        kind = type(given[0])
        distinct = kind.distinct
        with monkeypatch.context() as patch:
            patch.setattr(kind, "distinct", lambda df: made.append((df.count(), distinct(df).count())) or distinct(df))
            return across(*given)

    monkeypatch.setattr(ngramjoin, "across", counted)
    rows = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(60)]
        for i in range(5):
            t = list(base)
            for at in (10 * i, 10 * i + 5):
                t[at] = f"own{family}x{i}x{at}"
            rows.append((len(rows), " ".join(t)))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.unset(setting)
    assert got == components(rows)
    assert [n for n, _ in made] == [n for _, n in made] and made[0][0] > 20


def test_ngram_join_sends_no_more_than_the_texts_grow(spark, monkeypatch):
    """Pairs below the similarity meet in as many lists as their texts have prefix tokens: what the lists send on grows with them,
    not with their square."""
    across = ngramjoin.across

    def sent(n):
        values = []

        def counted(*given):
            kind = type(given[0])
            repartition = kind.repartition

            def noted(df, *by):
                total = sum((F.size(c) if t.startswith("array") else F.lit(1) for c, t in df.dtypes), F.lit(0))
                values.append(df.agg(F.sum(total)).first()[0] or 0)
                return repartition(df, *by)

            with monkeypatch.context() as patch:
                patch.setattr(kind, "repartition", noted)
                return across(*given)

        monkeypatch.setattr(ngramjoin, "across", counted)
        rows = []
        for family in range(6):
            base = [f"f{family}w{i}" for i in range(n)]
            rows.append((2 * family, " ".join(base)))
            rows.append((2 * family + 1, " ".join(f"own{family}x{i}" if i % 18 == 9 else w for i, w in enumerate(base))))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(frame(spark, rows)).collect()}
        assert got == components(rows) == {i: (n - 4, i) for i in range(12)}
        return sum(values)

    few, many = sent(300), sent(1200)
    assert 100 < few and many < 6 * few


def test_pairs_across_components_equal_a_plain_count(spark, monkeypatch):
    """Members of short and long lists of all kinds: pairs that share enough in short lists, in long ones, or only in both."""
    monkeypatch.setattr(ngramjoin, "FEW", 5)
    random = np.random.default_rng(7)
    many, having = 60, defaultdict(list)
    n, wide, label = random.integers(40, 60, many), random.random(many) < 0.4, random.integers(0, 30, many)
    for k in range(120):
        kind = int(random.integers(3))
        group = random.choice(12) * 5 + np.arange(5)
        some = random.choice(group, int(random.integers(2, 6)), replace=False) if k % 6 else random.choice(many, 25, replace=False)
        having[4 * k + kind] = [v for v in some.tolist() if kind != ngramjoin.PAIR or not wide[v]]
    rows = [(sig, v, int(n[v]), bool(wide[v]), int(label[v]), 0, 1000, len(vs), True) for sig, vs in having.items() for v in vs]
    members = spark.createDataFrame(rows, "sig long, v long, n long, wide boolean, label long, need long, met long, size long, decides boolean")
    got = sorted(map(tuple, ngramjoin.across(members).collect()))
    want, by = [], set()
    for a in range(many):
        for b in range(many):
            both = [(sig, len(vs)) for sig, vs in having.items() if a in vs and b in vs]

            def enough(sigs):
                rare, pairs, alone = (sum(sig & 3 == kind for sig, _ in sigs) for kind in range(3))
                frequent = alone if wide[a] or wide[b] else int((1 + (1 + 8 * pairs) ** 0.5) / 2)
                return rare + frequent >= ngramjoin.least_shared(n[a], n[b])

            serving = [x for x in both if x[0] & 3 != ngramjoin.WIDE or wide[a] or wide[b]]
            if label[a] < label[b] and 4 * n[a] >= 3 * n[b] and 4 * n[b] >= 3 * n[a] and serving and enough(both):
                want.append((a, b))
                by.add((enough([x for x in both if x[1] <= 5]), enough([x for x in both if x[1] > 5]), any(x[1] <= 5 for x in serving)))
    assert got == want
    assert {(True, False, True), (False, False, True), (False, True, False)} <= by


def test_shared_signatures_are_counted_pair_by_pair():
    random = np.random.default_rng(2)
    sigs = [np.unique(random.integers(-30, 30, int(k))) & ~3 | 4 * (k % 2) | int(k) % 3 for k in random.integers(1, 30, 40)]
    sigs = [np.unique(np.concatenate((x, random.integers(0, 20, 5) * 4 + random.integers(0, 3, 5)))) for x in sigs]
    i, j = np.triu_indices(40, 1)
    got = ngramjoin._in_common_of(sigs, i, j)
    assert got.tolist() == [[len({s for s in set(sigs[a]) & set(sigs[b]) if s & 3 == kind}) for a, b in zip(i, j)] for kind in range(3)]


def test_shared_signatures_are_counted_in_blocks_of_rows():
    random = np.random.default_rng(1)
    sigs = [np.unique(random.integers(0, 50, int(k))) for k in random.integers(0, 30, 40)]
    owner, column = np.repeat(np.arange(40), [len(x) for x in sigs]), np.concatenate(sigs)
    got = np.concatenate([ngramjoin._in_common(owner, column, low, min(low + 7, 40), 40) for low in range(0, 40, 7)])
    assert got.tolist() == [[len(set(a) & set(b)) for b in sigs] for a in sigs]


def test_ngram_join_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, None), (9, "z")]
    got = sorted(map(tuple, ngramjoin.join(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (None, 0, None), (9, 1, 9)], key=str)
    assert ngramjoin.join(frame(spark, rows).limit(0)).count() == 0


def cleaned(rows):
    """The chunk rule text by text: (id, text) in any order, ids may repeat; a text per row."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    le = lambda h: h.to_bytes(8, "little")

    def chunks(text):
        cut = [x for x in re.split(r"(?<=\n)|(?<=\. )", text or "") if x]
        hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in cut]
        rolled = [signed(xxhash.xxh64_intdigest(le(h), seed=xxhash.xxh64_intdigest(le(hashes[i - 1]), seed=42) if i else 42)) for i, h in enumerate(hashes)]
        found = [(i, i) for i, x in enumerate(cut) if len(x.encode()) >= 40]
        found += [(i - 1, i) for i in range(1, len(cut) - 1) if (rolled[i - 1] < rolled[i] >= rolled[i + 1] or rolled[i - 1] > rolled[i] <= rolled[i + 1]) 
                  and max(len(x.encode()) for x in cut[i - 1 : i + 1]) < 40 and len((cut[i - 1] + cut[i]).encode()) >= 32]
        return cut, [("".join(cut[i : j + 1]), j > i, i, j) for i, j in sorted(found)]

    made, places = [(i, *chunks(t)) for i, t in rows], defaultdict(list)
    for i, _, found in made:
        for text, two, *_ in found:
            places[text, two].append(i)
    out = []
    for own, cut, found in made:
        gone, seen = set(), set()
        for text, two, i, j in found:
            ids = [x for x in places[text, two] if x is not None]
            if len(places[text, two]) > 1 and ids and ((text, two) in seen or own is None or min(ids) < own):
                gone |= {i, j}
            seen.add((text, two))
        out.append("".join(x for k, x in enumerate(cut) if k not in gone))
    return out


def test_line_dedup_on_the_tables(spark):
    rows = documents(spark)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in QUERIES["op7_line_dedup"](spark, DATA).collect()}
    count = lambda t: len([x for x in re.split(r"(?<=\n)|(?<=\. )", t or "") if x])
    want = dict(zip([i for i, _ in rows], cleaned(rows)))
    assert {i: g[0] for i, g in got.items()} == want
    assert all(g[1] == count(t) and 0 <= g[2] <= g[1] for (i, t), g in zip(rows, (got[i] for i, _ in rows)))
    assert sum(g[2] for g in got.values()) > 100


def test_line_dedup_odd_rows(spark):
    shared = "".join(f"line {i} of a passage that is long enough to have many lines\n" for i in range(12))
    long = "one line of more than sixty-four bytes that stands in several texts of the table\n"
    rows = [(1, f"own start\n{shared}own end\n"), (2, f"other text\nmore\n{shared}"), (3, shared + shared), (4, ""), (5, "x\x1fy. z\n" + shared), (6, "l\n" * 3000),
            (8, None), (None, shared), (2, f"other text\nmore\n{shared}"), (2, "another text of this id\n" + long), (None, "only here. " * 30 + long),
            (9, f"{long}a. b. c. {long}{long}"), (10, "é É. " * 4 + "x" * 200_000), (11, "x" * 200_000)]
    whole = frame(spark, rows)
    out = linededup.clean(whole)
    assert out.columns == whole.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(i, None if t is None else c) for (i, t), c in zip(rows, cleaned(rows))]
    assert got == sorted(want, key=str)
    assert want[0] == rows[0] and want[1] == want[8] and len(want[7][1]) < len(shared) and want[11][1] == "a. b. c. "
    assert linededup.clean(whole.limit(0)).count() == 0


def test_line_dedup_cuts_no_line(spark):
    """A clause that another document holds stays where it is inside a line."""
    rows = [(1, "According to the latest yearly report of the agency, rain fell in Oslo. Nobody saw it, they say.\n"),
            (2, "In May, according to nobody. According to the latest yearly report of the agency, prices fell in Rome.\n")]
    assert sorted((r.doc_id, r.text) for r in linededup.clean(frame(spark, rows)).collect()) == rows


def test_line_dedup_leaves_no_repeated_passage(spark):
    """A plain search for 50 words in a row that several documents hold. Passages of whole lines all go. Of those that begin and
    end inside lines nearly all do: some have hardly a whole line, and no line is cut."""
    random = np.random.default_rng(5)
    word = lambda: "".join(random.choice(list("abcdefghij"), 5))

    def prose(n):
        return " ".join(word() + str(random.choice(["", "", "", "", "", ",", ".", ".\n"], p=[0.15] * 5 + [0.1, 0.1, 0.05])) for _ in range(n)).replace("\n ", "\n")

    passages = [prose(int(random.integers(51, 81))) for _ in range(60)]
    rows = [(i, f"{prose(int(random.integers(3, 60)))} {passages[i % 60]} {prose(int(random.integers(3, 60)))}") for i in range(180)]
    whole = [(i, f"{prose(int(random.integers(3, 60)))}. {passages[i % 60]}.\n{prose(int(random.integers(3, 60)))}") for i in range(180)]

    def held(rows):
        found = defaultdict(set)
        for i, text in rows:
            w = text.split()
            for k in range(len(w) - 49):
                found[tuple(w[k : k + 50])].add(i)
        return {i for ids in found.values() if len(ids) > 1 for i in ids}

    got = [(r.doc_id, r.text) for r in linededup.clean(frame(spark, rows)).collect()]
    assert len(held(rows)) == 180 and len(got) == 180 and len({i % 60 for i in held(got)}) <= 2
    assert all(dict(got)[i] == t for i, t in rows[:60])  # the first holders lose nothing
    got = [(r.doc_id, r.text) for r in linededup.clean(frame(spark, whole)).collect()]
    assert len(held(whole)) == 180 and not held(got) and all(dict(got)[i] == t for i, t in whole[:60])


def test_line_dedup_keeps_a_row_per_text_of_one_id(spark):
    texts = ["".join(f"line {i} of passage number {k}, which many texts of one id have in common\n" for i in range(5)) for k in range(40)]
    rows = [(1, "".join(texts)), *[(i, t) for i in (2, None) for t in texts]]
    assert max(len(r.lost) for r in linededup.losses(frame(spark, rows)).collect()) <= 9
    got = [r.text for r in linededup.clean(frame(spark, rows)).collect() if r.doc_id != 1]
    assert got == [""] * 80


def test_line_dedup_runs_no_python(spark):
    plan = QUERIES["op7_line_dedup"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = QUERIES["op1_license_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def packed_right(rows, pieces):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    total = 0
    for i, text in rows:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], 0
        found = sorted(own[i], key=lambda p: p.piece)
        assert [p.piece for p in found] == list(range(-(-len(ids) // 2048)))
        for p in found:
            assert p.start == at and (p.length == 2048 or p.piece == 0)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes())
        assert at == len(ids)
        total += at
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    return len(sequences), total


def test_packing_on_the_tables(spark):
    sequences, total = packed_right(documents(spark), QUERIES["op5_packing"](spark, DATA).collect())
    assert sequences <= -(-total // 2048) + 1


def test_packing_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    rows = list(enumerate(["", None, " ", "a  b   c", "x \n y\n\n z", "tab\t t", "<|endoftext|> it's", "a<|endoftext|><|endoftext|>  b <|endoftext|> c", "é" * 3000, "word " * 9000, "nbsp  x  y", "end\n", " lead", "trail "] + ["same text"] * 20))
    sequences, total = packed_right(rows, packing.packed(frame(spark, rows), *PACK).collect())
    assert sequences <= -(-total // 2048) + 1
    assert packing.packed(frame(spark, rows).limit(0), *PACK).count() == 0
    assert packing.packed(frame(spark, [(None, "a"), (1, "b"), (1, "b")]), *PACK).count() == 3
    for kind in ("int", "string", "smallint"):
        typed = packing.packed(frame(spark, [(1, "a"), (2, None)]).withColumn("doc_id", F.col("doc_id").cast(kind)), *PACK)
        assert dict(typed.dtypes)["doc_id"] == kind and sorted(str(r.doc_id) for r in typed.collect()) == ["1", "2"]


def test_fullest_combination():
    random = np.random.default_rng(5)
    for _ in range(200):
        counts = {int(x): int(random.integers(1, 5)) for x in random.integers(1, 40, 6)}
        room = int(random.integers(1, 120))
        reach = {0}
        for length, n in counts.items():
            reach = {s + k * length for s in reach for k in range(n + 1) if s + k * length <= room}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(reach) and all(n <= counts[k] for k, n in used.items())


def test_topk_on_the_tables(spark):
    assert spark_table(QUERIES["op8_bit_sliced_topk"](spark, DATA)) == duck_table(connect(DATA), SQL["op8_bit_sliced_topk"])


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (7, [-1.0, 1.0]), (8, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "vec_id AS id", "vec_id AS score")
    got = topk.search(vectors, F.col("id") == 0, k=3, per_round=1, block=2).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 128**2 + 64**2), (2, 2, 128**2 + 64**2), (3, 7, 0)]
    assert topk.search(vectors.limit(0), F.col("id") == 0, k=3).count() == 0


def test_bit_slices_equal_products():
    random = np.random.default_rng(2)
    for n in (1, 63, 300):
        values = random.integers(-300, 300, (n, 7))
        values[n // 2 :] = values[0]
        block = topk.Block(np.arange(n), values)
        for query in (*random.integers(-300, 300, (5, 7)), np.zeros(7, np.int64)):
            ids, scores = block.best(0, query, 4)
            want = sorted((-(values[i] @ query), i) for i in range(1, n))[:4]
            assert [(-s, i) for i, s in zip(ids, scores)] == want


def nearest_plain(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edit_distance():
    random = np.random.default_rng(4)
    for _ in range(200):
        pattern, text = random.integers(0, 4, int(random.integers(1, 9))).tolist(), random.integers(0, 4, int(random.integers(0, 20))).tolist()
        assert decontaminate.nearest(decontaminate.masks(pattern), len(pattern), text)[0] == nearest_plain(pattern, text)


def test_decontamination_on_the_tables(spark):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op3_decontamination"](spark, DATA).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
    patterns = [(x.item_id, split(x.text)) for x in items]
    for doc_id, text in documents(spark):
        w = split(text)
        for item_id, p in patterns:
            if len(set(w) & set(p)) >= 0.7 * len(set(p)):
                distance = decontaminate.nearest(decontaminate.masks(p), len(p), w)[0]
                assert got.get((doc_id, item_id)) == (distance if distance <= decontaminate.allowed(len(p)) else None)
            else:
                assert (doc_id, item_id) not in got


@pytest.mark.parametrize("kinds", decontaminate.EDIT_KINDS, ids="-".join)
def test_decontamination_recall_by_length_and_kind_of_edit(kinds):
    """Items of 5 to 400 words with as many edits as allowed, inside other words, are found nearly always."""
    random = np.random.default_rng(len(kinds[0]))
    word = lambda n: random.integers(1, 1 << 62, n).astype(np.uint64)
    for length in (5, 9, 15, 31, 63, 64, 90, 120, 200, 300, 400):
        items = [word(length) for _ in range(60)]
        index = decontaminate.Index(list(range(60)), items)
        texts = [np.concatenate((word(30), decontaminate._edited(w, decontaminate.allowed(length), random, kinds), word(30))) for w in items]
        words = Words.__new__(Words)
        words.hash = np.concatenate(texts)
        words.first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        words.of = np.repeat(np.arange(60), np.diff(words.first))
        found = {(of, item) for of, item, *_ in index.matches(words)}
        assert all(of == item for of, item in found)
        assert len(found) >= 0.97 * 60, (length, kinds, len(found))


def test_decontamination_recall_of_edited_items(spark):
    random = np.random.default_rng(6)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(random.choice(vocabulary, 8 + i % 50))) for i in range(100)]
    docs = []
    for i, text in items:
        w = text.split()
        for at in random.choice(len(w), decontaminate.allowed(len(w)), replace=False):
            w[at] = "other"
        docs.append((i, " ".join([*random.choice(vocabulary, 30), *w, *random.choice(vocabulary, 30)])))
    docs += [(1000 + i, " ".join(random.choice(vocabulary, 300))) for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert sum((i, i) in got for i, _ in items) >= 97 and not any(d >= 1000 for d, _ in got)
    assert all(r.end - r.start > 0 and r.start >= 25 for r in got.values())


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, "a b"), (None, "a b c d e f g")], "item_id long, text string").selectExpr("item_id", "text", "text AS doc_id")
    docs = frame(spark, [(1, "x A B c. d e f g y"), (1, "x A B c. d e f g y"), (2, None), (None, "a b c d e f g"), (3, "a b"), (4, "")])
    got = sorted((str(r.doc_id), r.item_id, r.start, r.end, r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    assert set(got) == {("1", 1, 1, 8, 0), ("None", 1, 0, 7, 0)}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["2", "3", "4"]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("name,column,mod,held", [("op6_quality_classifier", "quality", 3, 1), ("op10_toxicity_classifier", "toxic", 5, 0)])
def test_classifiers_hold_out(spark, name, column, mod, held):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in unseen) >= 0.9 * len(unseen)


@pytest.mark.parametrize("judge", [quality.judge, toxicity.judge])
def test_classifiers_odd_rows(spark, judge):
    docs = frame(spark, [(i, f"good words number {i} here" if i % 2 else f"bad!!! ### {i} rubbish trash") for i in range(60)] + [(100, ""), (101, None), (None, "x"), (5, "again"), (102, "long " * 50_000)])
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(60)] + [(3, 0, 0, "x"), (None, 1, 1, "x"), (7, None, None, "x"), (9, 5, 5, "x")], "doc_id long, quality int, toxic int, text string")
    rows = judge(docs, labels).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in judge(docs, labels.limit(0)).collect()} == {0.5}
    assert judge(docs.limit(0), labels).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(8)
    x = random.normal(size=(40, 3))
    y = np.where(x[:, 0] + 0.3 * random.normal(size=40) > 0, 1.0, -1.0)
    cost = np.full(40, 0.7)
    w = nbsvm.descend([np.arange(3)] * 40, list(x), y, 3, cost, 2000)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:3] + v[3]))).sum()
    assert all(primal(w) <= primal(w + d) + 1e-3 for d in random.normal(scale=0.05, size=(300, 4)))


def test_toxicity_features_are_grams_of_characters():
    """Every 4, 5 and 6 characters of the folded text, non-ASCII letters counting as one."""
    texts = ["Größe MÜ!!x", "", "ab", "\u6f22\u5b57 \U0001F600\U0001F601 z", "aaaa aaaa"]
    folded = [" " + re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).strip(" ") + " " if t else "" for t in texts]
    want = [{t[i : i + n] for n in (4, 5, 6) for i in range(len(t) - n + 1)} for t in folded]
    got = [set() for _ in texts]
    for rows, found in toxicity.features(pa.array(texts)):
        for r, f in zip(rows.tolist(), found.tolist()):
            got[r].add(f)
    assert [len(g) for g in got] == [len(w) for w in want]
    same = [set() for _ in folded]
    for rows, found in toxicity.features(pa.array([t.strip(" ") for t in folded])):
        for r, f in zip(rows.tolist(), found.tolist()):
            same[r].add(f)
    assert same == got


def test_a_model_of_repeated_ids_is_repeatable(spark):
    """Ids with several texts: the same model at any partitioning, and that of a table with one of the texts."""
    rows = [(i, f"{'good' if i % 2 else 'awful'} words number {i} {k}") for i in range(40) for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = [nbsvm.train(d, labels, "quality", F.lit(True), quality.features, quality.SIZE, bound=25) for d in (docs.repartition(1), docs.repartition(7), docs.orderBy(F.desc("text")))]
    assert all((models[0].weights == m.weights).all() and models[0].bias == m.bias for m in models) and models[0].weights.any()


def test_a_fit_takes_less_room_than_its_sample():
    """16 MB of features: ordering and fitting them takes no 8-byte value for each, nor a copy of all lists; the weights are those of
    values laid out beforehand, to the bit."""
    random = np.random.default_rng(5)
    size, n = 1 << 16, 4000
    column = pa.chunked_array([pa.array(np.sort(random.integers(0, size, (n // 2, 1000)).astype(np.int32), axis=1).tolist(), pa.list_(pa.int32())) for _ in range(2)])
    labels, ratio = random.integers(0, 2, n), random.normal(size=size)
    tracemalloc.start()
    lists = nbsvm.lists_of(column)
    order = nbsvm.ordered(labels, lists)
    model = nbsvm.fit([lists[i] for i in order], labels[order], ratio, rounds=1)
    room = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert room < 8 << 20
    plain = [np.array(x, np.int32) for x in column.to_pylist()]
    assert order == sorted(range(n), key=lambda i: (labels[i], plain[i].tobytes()))
    weight = np.where(labels == 1, n / 2 / (labels == 1).sum(), n / 2 / (labels == 0).sum())[order]
    rows = [plain[i] for i in order]
    weights = nbsvm.descend(rows, [ratio[r] for r in rows], np.where(labels[order] == 1, 1.0, -1.0), size, weight, 1)
    assert (model.weights == (weights[:-1] * ratio).astype(np.float32)).all() and model.bias == weights[-1] and model.weights.any()


def test_lists_with_the_same_beginning_are_ordered_by_the_rest():
    rows = [[*range(16), 9], [*range(16), 5, 7], [*range(16), 5], [], [*range(16)], [300], [3], [*range(16), 5]]
    lists, labels = [np.array(x, np.int32) for x in rows], np.array([0, 0, 0, 1, 0, 0, 0, 1])
    assert nbsvm.ordered(labels, lists) == sorted(range(8), key=lambda i: (labels[i], lists[i].tobytes()))
    column = pa.chunked_array([pa.array(rows, pa.list_(pa.int32())).slice(2, 4), pa.array([], pa.list_(pa.int32()))])
    assert [x.tolist() for x in nbsvm.lists_of(column)] == rows[2:6]
    assert nbsvm.lists_of(pa.chunked_array([], pa.list_(pa.int32()))) == []


def test_pipeline_plans_the_join_once(spark):
    """What the n-gram join stage returns reads documents and written copies alone, for rows with and without an id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, DATA)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= 4


def test_pipeline_equals_brute_force(spark):
    docs, rows = spark.read.parquet(f"{DATA}/documents.parquet"), documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    good = stages["quality_classifier"](spark, docs, DATA).cache()
    judged = {r.doc_id for r in QUERIES["op6_quality_classifier"](spark, DATA).where("predicted = 1").collect()}
    rows = [(i, t) for i, t in rows if i in judged]
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == judged
    lines = stages["line_dedup"](spark, good, DATA).cache()
    before, rows = rows, list(zip([i for i, _ in rows], cleaned(rows)))
    rows = [(i, t) for (i, t), (_, old) in zip(rows, before) if t.strip() or not old.strip()]
    assert {(r.doc_id, r.text, r.n_chars) for r in lines.collect()} == {(i, t, len(t)) for i, t in rows}
    single = stages["ngram_jaccard_join"](spark, lines, DATA).cache()
    keep = {i for i, (_, c) in components(rows).items() if i == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == keep
    free = stages["benchmark_decontamination"](spark, single, DATA).cache()
    leaking = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    rows = [(i, t) for i, t in rows if i in keep - leaking]
    assert free.columns == docs.columns and {(r.doc_id, r.text) for r in free.collect()} == set(rows)
    packed_right(rows, stages["best_fit_packing"](spark, free, DATA).collect())


def test_pipeline_makes_each_cleaned_text_once(spark):
    """No filter of the plan holds a lambda: it would split a text once more for each of its lines."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, DATA)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if re.match(r"\W*Filter ", x)]
    assert any("n_removed" in x for x in filters) and not any("lambdafunction" in x for x in filters)


def test_pipeline_odd_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"row": F.lit(1), "own": F.lit("x"), "score": F.lit(None).cast("string")})
    odd = docs.limit(5).unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            now = out.cache()
    assert out.count() >= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
