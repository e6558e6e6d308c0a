"""SimHash near duplicates, whitening and periodic runs against brute force, and their defined edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from rulespan.llm import periodic, simhash, whitening
from rulespan.llm.queries import QUERIES, repeated_tails

DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "doc_id AS fp", "text AS label", "doc_id AS sig", "text AS `runs`", "doc_id AS n")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- fingerprints


def plain_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, radius=4):
    """The index of the smallest value's position reachable, for each value."""
    values = np.array(values, np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates_on_the_tables(spark):
    rows = sorted(documents(spark))
    prints = [plain_fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots(prints))}
    got = QUERIES["op11_simhash"](spark, DATA)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    rows = [(5, ""), (3, None), (9, " \t\n"), (4, "One two"), (6, "ONE  two"), (7, "é É"), (7, "other words of one id here"), (None, "one two"), (8, long), (8, long), (None, "nothing like it at all")]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    known = {t: plain_fingerprint(t) for _, t in rows}
    ids = sorted({i for i, _ in rows if i is not None})
    low = {}
    order = [t for _, t in rows]
    parts = roots([known[t] for t in order])
    for (i, _), r in zip(rows, parts):
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    assert got == sorted([(i, f"{known[t]:016x}", low[r]) for (i, t), r in zip(rows, parts)], key=str) and ids
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("portion", [6, 4096])
def test_links_of_crowded_lists(spark, portion):
    """Points crowded round a few centres, more than a portion holds, so that lists are split and get further lists."""
    random = np.random.default_rng(portion)
    values = {0, 1, (1 << 64) - 1}
    for centre in random.integers(0, 1 << 63, 3).tolist():
        for _ in range(60):
            flips = random.choice(64, int(random.integers(0, 9)), replace=False)
            values.add(centre ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    points = spark.createDataFrame([(v,) for v in signed], "fp long")
    labels = {r.v: r.label for r in simhash.links(points.repartition(5), portion=portion).collect()}
    want = roots(values)
    groups = {}
    for v, r in zip(signed, want):
        groups.setdefault(r, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(labels.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert len(groups) > 5


def test_lists_miss_no_link(spark):
    """Any two points within the radius share a first list, and one more of its further lists."""
    random = np.random.default_rng(7)
    for _ in range(200):
        a = int(random.integers(0, 1 << 63))
        b = a ^ sum(1 << int(x) for x in random.choice(64, 4, replace=False))
        first = simhash.pieces(list(range(64)), 6)
        equal = [m for m in first if not (a ^ b) & m & (1 << 64) - 1]
        assert len(equal) >= 2
        mask = equal[0] | equal[1]
        free = simhash.pieces([i for i in range(64) if not mask >> i & 1], 5)
        assert any(not (a ^ b) & m & (1 << 64) - 1 for m in free)


def test_pivots_discard_only_what_is_further_apart():
    random = np.random.default_rng(2)
    points = random.integers(0, 1 << 63, 400).astype(np.uint64)
    points = np.concatenate((points, points[:100] ^ np.uint64(0b10110)))
    table = simhash.distances(points)
    apart = np.bitwise_count(points[:, None] ^ points[None, :])
    bound = np.abs(table[:, None, :].astype(int) - table[None, :, :]).max(axis=2)
    assert (bound <= apart).all()
    assert ((bound <= 4) & (apart > 4)).mean() < 0.01


# ---- whitening


def plain_whitening(rows):
    """x, the distinct x, their covariance and its eigenvalues, by numpy."""
    x = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    centred = fit - fit.mean(axis=0)
    return x, fit, centred.T @ centred / len(fit)


def check_whitening(rows, got, k):
    x, fit, v = plain_whitening(rows)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    table = {}
    for r in got:
        table.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(table) == list(range(1, k + 1))
    for c in range(1, k + 1):
        assert set(table[c]) == set(x)
        u, e = vectors[:, c - 1], values[c - 1]
        want = {i: float((xi - total / n) @ u / e**0.5) for i, xi in x.items()}
        top = max(want, key=lambda i: abs(want[i]))
        sign = 1 if want[top] * table[c][top].whitened > 0 else -1
        for i, r in table[c].items():
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
            assert r.whitened == pytest.approx(sign * want[i], rel=1e-8, abs=1e-8)
            assert r.explained == pytest.approx(e / np.trace(v), rel=1e-10)
            assert 0 <= r.identity_error < 1e-9


def test_whitening_on_the_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, DATA)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check_whitening(rows, got.collect(), 4)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "vec_id AS n", "embedding AS x", "vec_id AS v", "vec_id AS component")


def test_whitening_odd_rows(spark):
    random = np.random.default_rng(5)
    good = [(i, random.normal(size=6).tolist()) for i in range(40)]
    good += [(100 + i, good[0][1]) for i in range(300)] + [(500, [-0.0] * 6)]
    bad = [(901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, []), (906, [1.0, 2.0])]
    check_whitening(good, whitening.whiten(vectors(spark, good + bad)).collect(), 4)
    assert whitening.whiten(vectors(spark, good).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, bad[:1] + bad[2:5])).count() == 0
    # no variance; one direction of variance; ids that repeat or are null
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [3.0, 6.0]), (None, [2.0, 4.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, round(abs(r.whitened), 6)) for r in line) == [(0, 1, 0.0), (1, 1, 1.224745), (1, 1, 1.224745)]
    huge = whitening.whiten(vectors(spark, [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [5.0, 1.0])]), components=1).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and all(abs(r.identity_error) < 1e-4 for r in huge)


def test_inertia_and_leading_eigenvalues():
    random = np.random.default_rng(3)
    for case in range(60):
        d = int(random.integers(1, 30))
        q = np.linalg.qr(random.normal(size=(d, d)))[0]
        values = [random.random(d), np.array(random.choice([1.0, 2.0, 2.0, 7.0], d)), np.exp(-1.5 * np.arange(d)), (np.arange(d) % 3 == 0) * 1.0][case % 4]
        matrix = q @ np.diag(values) @ q.T
        matrix = (matrix + matrix.T) / 2
        known = np.linalg.eigvalsh(matrix)[::-1]
        for shift in random.uniform(-0.5, 8, 4):
            assert whitening.above(matrix, shift) == (known > shift).sum()
        e, u = whitening.leading(matrix, 4)
        assert len(e) == min(4, (known > 1e-12 * known[0]).sum())
        assert np.allclose(e, known[: len(e)], rtol=1e-12, atol=1e-13 * known[0])
        assert np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-12 and np.abs(matrix @ u - u * e).max(initial=0) < 1e-11 * known[0]


# ---- periodic runs


def plain_runs(w, least=6, times=4):
    """Every stretch of each period in turn; a stretch counts for its smallest period."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, times * q) and not any(all(s[k] == s[k + r] for k in range(len(s) - r)) for r in range(1, q)):
                out.append((i, len(s), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def tail(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_periodic_runs_on_the_tables(spark):
    want = {i: plain_row(w, plain_runs(w)) for i, w in ((i, tail(i, words(t))) for i, t in documents(spark))}
    got = QUERIES["op13_periodic_runs"](spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 5


def test_periodic_runs_of_random_words(spark):
    random = np.random.default_rng(11)
    rows = []
    for i in range(400):
        w = ["abcd"[k] for k in random.integers(0, int(random.integers(1, 5)), int(random.integers(0, 70)))]
        for _ in range(int(random.integers(0, 3))):
            if len(w) > 5:
                a, p = int(random.integers(len(w))), int(random.integers(1, 7))
                for k in range(a, min(len(w), a + int(random.integers(4, 40)))):
                    w[k] = w[a + (k - a) % p]
        rows.append((i, "  ".join(w)))
    docs = frame(spark, rows).repartition(3)
    for least, times in ((6, 4), (4, 2), (3, 3), (9, 2)):
        got = {r.doc_id: r for r in periodic.find(docs, least=least, times=times).collect()}
        for i, t in rows:
            w = words(t)
            runs = plain_runs(w, least, times)
            assert [tuple(r) for r in got[i].runs] == runs
            gone = {k for a, n, q in runs for k in range(a + q, a + n)}
            assert got[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_periodic_runs_odd_rows(spark):
    block = " ".join(f"w{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 30_000), (5, "\n".join([block] * 5)), (5, "A a A a A a A a a a"), (None, "é é é é é é É")]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], len(r.collapsed)) for r in periodic.find(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, [], 0), (2, [], 0), (3, [], 0), (4, [(0, 30_000, 1)], 1), (5, [(0, 25_000, 5000)], len(block)),
                          (5, [(0, 8, 2)], 7), (None, [(0, 6, 1)], 3)], key=str)
    assert periodic.find(frame(spark, rows).limit(0)).count() == 0


def test_repeated_tails_equal_the_rule(spark):
    rows = [(i, "  ".join(f"w{k % 50}" for k in range(i % 40))) for i in range(400)] + [(None, "a b c"), (1000, None)]
    got = {r.doc_id: words(r.text) for r in repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: words(t) if i is None else tail(i, words(t)) for i, t in rows}
