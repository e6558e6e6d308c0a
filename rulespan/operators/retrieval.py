"""Dense top-k retrieval and url ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.functions.text import url_host, url_path

DEFAULT_K = 5
#: Queries sent to every task; more are dealt out with the corpus.
MAX_BROADCAST_QUERIES = 4096
#: Rows of the corpus, and of the queries, that meet in one task.
BLOCK = 65_536
#: Fewest queries of a task: blocks are cut down to this where there would be too few tasks.
LEAST_QUERIES = 4096
#: Queries scored at a time, and cells of the score matrix a task then holds (4 MB).
SCORE_QUERIES = 512
SCORE_CELLS = 1_000_000
#: Items looked at before there is a k-th best score to hold others against.
FIRST_ITEMS = 1024
#: Pairs whose vectors are gathered to be scored again.
EXACT_PAIRS = 65_536
#: Scores are rounded before ranking, so that equal vectors tie in any order of summation.
SCORE_DIGITS = 9
#: A change in the last digit, which is more than two summations of a pair differ by.
LAST_DIGIT = 10.0**-SCORE_DIGITS

HITS = "query_id long, item_id long, score double"


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length one; a zero vector stays zero and scores 0 everywhere."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors)
    if len(lengths) and pc.min(lengths) != pc.max(lengths):
        raise ValueError("all vectors must have the same length")
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(vectors), lengths[0].as_py() if len(lengths) else 0)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1.0, norm)


def _rows(ids: pa.Array | pa.ChunkedArray, vectors: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows that have a direction; the others make no pair."""
    own, matrix = ids.to_numpy(), _unit(vectors)
    whole = np.isfinite(matrix).all(axis=1)
    return (own, matrix) if whole.all() else (own[whole], matrix[whole])


class _Best:
    """The k best items for each of some queries, over the items added so far; ties go to the smaller id.

    Single precision only passes over items: its error is below ``slack``, so whatever may be among the best is scored again
    in double precision. While the ids ascend, an item that ties with the k-th best comes too late.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, skip_self: bool) -> None:
        self.query_ids, self.queries, self.k, self.skip_self = query_ids, queries, k, skip_self
        self.single = queries.astype(np.float32)
        # Twice (d + 2) units of rounding, the bound for a sum of d products of vectors of length one.
        self.slack = (queries.shape[1] + 8) * 2.0**-23 + 2 * LAST_DIGIT
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.items = np.zeros((len(query_ids), k), np.int64)
        self.last = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray) -> None:
        start, width = 0, FIRST_ITEMS
        while start < len(ids):
            at = slice(start, start + width)
            self._add(ids[at], vectors[at], single[at])
            start, width = at.stop, max(1, SCORE_CELLS // max(1, len(self.query_ids)))

    def _add(self, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray) -> None:
        late = self.last is not None and ids[0] >= self.last and bool((ids[1:] >= ids[:-1]).all())
        self.last = max(int(ids.max()), ids[0] if self.last is None else self.last)
        bar = self.scores[:, -1]
        begun = np.isfinite(bar)
        if not begun.all():
            self._first(np.flatnonzero(~begun), ids, vectors)
            if not begun.any():
                return
        # Rows without a bar have had these items already.
        low = np.where(begun, bar - self.slack, np.inf).astype(np.float32)
        over = self.single @ single.T > low[:, None]
        found = int(np.count_nonzero(over))
        if not found:
            return
        if found * 50 <= over.size:
            row, col = np.nonzero(over)
            self._merge(row, col, ids, vectors, bar, late)
            return
        some = np.flatnonzero(over.any(axis=1))
        exact = self.queries[some] @ vectors.T
        row, col = np.nonzero(exact > (bar[some] + (0.4 if late else -1) * LAST_DIGIT)[:, None])
        self._merge(some[row], col, ids, vectors, bar, late)

    def _first(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.queries[rows] @ vectors.T
        if self.skip_self:
            scores[self.query_ids[rows][:, None] == ids[None, :]] = -np.inf
        kept = min(self.k, len(ids))
        least = np.partition(scores, len(ids) - kept, axis=1)[:, len(ids) - kept]
        row, col = np.nonzero((scores >= least[:, None] - LAST_DIGIT) & np.isfinite(scores))
        self._merge(rows[row], col, ids, vectors, None, False)

    def _merge(self, row: np.ndarray, col: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bar: np.ndarray | None, late: bool) -> None:
        score = np.empty(len(row))
        for start in range(0, len(row), EXACT_PAIRS):
            at = slice(start, start + EXACT_PAIRS)
            score[at] = np.einsum("ij,ij->i", self.queries[row[at]], vectors[col[at]])
        score, item = np.round(score, SCORE_DIGITS), ids[col]
        use = np.ones(len(row), bool) if bar is None else score > bar[row] if late else score >= bar[row]
        if self.skip_self:
            use &= item != self.query_ids[row]
        row, item, score = row[use], item[use], score[use]
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([row, np.repeat(touched, self.k)])
        item = np.concatenate([item, self.items[touched].ravel()])
        score = np.concatenate([score, self.scores[touched].ravel()])
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        self.items[row[best], rank[best]], self.scores[row[best], rank[best]] = item[best], score[best]

    def hits(self) -> pa.RecordBatch:
        row, rank = np.nonzero(np.isfinite(self.scores))
        columns = self.query_ids[row], self.items[row, rank], self.scores[row, rank]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "item_id", "score"])


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = DEFAULT_K,
    *,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "embedding",
    source: str | None = None,
    sources: Sequence | None = None,
    skip_self: bool = False,
    max_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """Per query the ``k`` corpus items of highest cosine, exact, as (query_id, item_id, score, rank).

    Every task scores blocks with a matrix product and keeps ``k`` hits per query, so the pairs are never
    rows of a table. ``sources`` limits the corpus to items whose ``source`` column is among them. Up to ``max_queries``
    queries are sent to every task; more stay out of the driver, and a task scores that many at a time.
    """
    if sources is not None:
        corpus = corpus.where(F.col(source).isin(*sources))
    items = corpus.select(F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v")).na.drop()
    wanted = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).alias("v")).na.drop()
    asked = wanted.count()
    hits = _sent_to_all(wanted, items, k, skip_self) if asked <= max_queries else _in_tiles(wanted, asked, items, k, skip_self, max_queries)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _sent_to_all(wanted: DataFrame, items: DataFrame, k: int, skip_self: bool) -> DataFrame:
    asked = wanted.toArrow()
    if not asked.num_rows:
        return items.sparkSession.createDataFrame([], HITS)
    shared = items.sparkSession.sparkContext.broadcast(_rows(asked.column("id"), asked.column("v")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        starts = range(0, len(query_ids), SCORE_QUERIES)
        best = [_Best(query_ids[i : i + SCORE_QUERIES], matrix[i : i + SCORE_QUERIES], k, skip_self) for i in starts]
        for batch in batches:
            if batch.num_rows:
                ids, vectors = _rows(batch.column("id"), batch.column("v"))
                single = vectors.astype(np.float32)
                for part in best:
                    part.add(ids, vectors, single)
        for part in best:
            yield part.hits()

    return items.mapInArrow(score, HITS)


def _in_tiles(wanted: DataFrame, asked: int, items: DataFrame, k: int, skip_self: bool, at_a_time: int) -> DataFrame:
    """Blocks of items against blocks of queries, a task for each two: it holds its items and lets its queries pass."""
    spark = items.sparkSession
    if items.schema["v"].dataType != wanted.schema["v"].dataType:
        items, wanted = (rows.withColumn("v", F.col("v").cast("array<double>")) for rows in (items, wanted))
    blocks = max(1, -(-items.count() // BLOCK))
    tasks = min(3 * spark.sparkContext.defaultParallelism, -(-asked // LEAST_QUERIES))
    parts = max(-(-asked // BLOCK), -(-tasks // blocks))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = items.withColumn("_own", dealt(blocks)).withColumn("_other", every(parts)).select(
        (F.col("_own") * parts + F.col("_other")).alias("tile"), F.lit(0).alias("side"), "id", "v")
    passing = wanted.withColumn("_own", dealt(parts)).withColumn("_other", every(blocks)).select(
        (F.col("_other") * parts + F.col("_own")).alias("tile"), F.lit(1).alias("side"), "id", "v")
    tiles = held.unionAll(passing).repartitionById(blocks * parts, "tile").sortWithinPartitions("tile", "side", "id")
    step = max(1, min(at_a_time, SCORE_QUERIES))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, block = None, [], None
        for batch in batches:
            keys = batch.column("tile").to_numpy() * 2 + batch.column("side").to_numpy()
            for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(keys)) + 1):
                if not len(piece):
                    continue
                some = batch.slice(int(piece[0]), len(piece))
                if keys[piece[0]] // 2 != tile:
                    tile, parts, block = keys[piece[0]] // 2, [], None
                found = _rows(some.column("id"), some.column("v"))
                if keys[piece[0]] % 2 == 0:
                    parts.append(found)
                    continue
                if block is None and parts:
                    ids, vectors = (np.concatenate(x) for x in zip(*parts))
                    block, parts = (ids, vectors, vectors.astype(np.float32)), []
                if block is None:
                    continue
                for start in range(0, len(found[0]), step):
                    best = _Best(found[0][start : start + step], found[1][start : start + step], k, skip_self)
                    best.add(*block)
                    yield best.hits()

    return tiles.mapInArrow(score, HITS)


# The points of a url, and the words that earn them.
TRUSTED_POINTS = 10
DOC_HOST_POINTS = 5
GUIDE_POINTS = 3
TOPIC_POINTS = 5
DOC_HOST_WORD = "doc"
GUIDE_WORDS = ["guide", "tutorial", "howto", "best-practices"]
TRUSTED_HOSTS = [
    "pandas.pydata.org",
    "stackoverflow.com",
    "github.com",
    "towardsdatascience.com",
    "medium.com",
    "kaggle.com",
    "datacamp.com",
    "pythonspeed.com",
    "docs.python.org",
    "realpython.com",
    "blog.jetbrains.com",
    "datascientist.com",
]
TOPIC = "pandas"


def _has_any(col: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(col, F.lit(word))
    return found


def url_scores(
    df: DataFrame,
    url: str,
    trusted: Column | Sequence[str] = TRUSTED_HOSTS,
    guide_words: Sequence[str] = GUIDE_WORDS,
    topic: str = TOPIC,
) -> DataFrame:
    """Web urls with their host, path and score; other rows are left out.

    ``trusted`` is a list of hosts, or a condition on the column ``host``.
    """
    split = df.where(F.col(url).startswith("http")).withColumns(
        {"host": url_host(F.col(url)), "path": F.lower(url_path(F.col(url)))}
    )
    is_trusted = F.col("host").isin(*trusted) if not isinstance(trusted, Column) else trusted

    def points(test: Column, n: int) -> Column:
        return F.when(test, F.lit(n)).otherwise(F.lit(0))

    score = (
        points(is_trusted, TRUSTED_POINTS)
        + points(F.contains(F.col("host"), F.lit(DOC_HOST_WORD)), DOC_HOST_POINTS)
        + points(_has_any(F.col("path"), guide_words), GUIDE_POINTS)
        + points(_has_any(F.col("host"), [topic]) | _has_any(F.col("path"), [topic]), TOPIC_POINTS)
    )
    return split.where(F.col("host").isNotNull()).withColumn("score", score)


def rank_urls(df: DataFrame, url: str, position: str, n: int = 5, **scoring) -> DataFrame:
    """The ``n`` best urls; equal scores keep the order of ``position``."""
    return url_scores(df, url, **scoring).orderBy(F.col("score").desc(), position).limit(n)
