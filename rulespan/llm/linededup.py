"""Line dedup by content-defined chunks of lines, in DataFrame functions alone.

A line ends at a line break or at a full stop and a space, and keeps that end, so that the lines of a text joined are
the text. A rolling hash goes over the hashes of two lines in a row. Its local extremes choose the boundaries, once with
one before each line that is no local maximum and once before each that is no local minimum; so a chunk has one line or two,
and where it begins depends on its own lines and their neighbours, not on what a text has before them: a passage copied into
another document is cut alike inside. Candidates are long lines (from ``LONG`` bytes) by themselves, since a passage may have
few lines, and chunks of two lines that aren't long (from ``SHORT`` bytes together).
Of a candidate's places the first in the smallest id stays, and each text loses the lines of its other places. No line is
cut. A line stays in the smallest id that has it in a repeated candidate, as nothing that holds it has an earlier place.

Hashes only bring places together: of a repeated candidate the text that keeps it sends its bytes to the texts that are to
lose it, and these compare them with their own before they lose anything. Candidates travel as hashes; only what repeats
travels as bytes. Places meet what repeats in a join, so a candidate that a third of all documents hold is spread by Spark's
skew join.

What stays: lines of a repeat at its edges, short lines at which no chunk of two ends, repeats of one short line, and repeats
with no whole line in them.

Defined cases: a null text stays null (an empty one empty) and has no lines; rows of the same id share their repeats, so
equal rows stay equal; a null id comes after all others, and null ids alone lose nothing to each other; ties cannot matter,
as equal candidates are equal bytes. The result has the input's columns, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.llm.common import kept_table

#: Bytes of a line that is a candidate by itself, and of two lines that are one.
LONG, SHORT = 40, 32
ENDS = ("\n", ". ")


def lines(text: Column) -> Column:
    # A mark after each end and a split at it is quicker than a split by a pattern, which texts with that mark take.
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + "\x1f"))
    found = F.when(F.contains(text, F.lit("\x1f")), F.split(text, r"(?<=\n)|(?<=[.] )", -1)).otherwise(F.split(marked, "\x1f", -1))
    return F.filter(found, lambda x: x != "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole row as ``row``, so that no name can clash, its id and a hash of its text."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"))
    return whole.withColumn("part", F.hash(_text(text_col)))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))


def _chunk(start: Column, two: Column) -> Column:
    """The bytes of one or two of ``cut`` from ``start`` on."""
    return F.when(two, F.concat(F.get("cut", start), F.get("cut", start + 1))).otherwise(F.get("cut", start))


def _candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, part) with ``cut`` (lines) and ``found``: hash, place (twice the number of the first line, one more for
    two lines), sorted. Each step is a column of its own: inside a lambda it would be computed per element."""
    cut = rows.withColumn("cut", lines(F.col("text")))
    hashed = cut.withColumn("hashes", F.transform("cut", lambda x: F.xxhash64(x)))
    rolled = hashed.withColumn("rolled", F.transform("hashes", lambda h, i: F.xxhash64(F.get("hashes", i - 1), h)))

    def at(x: Column, i: Column) -> Column:
        size, own = F.octet_length(x), F.get("rolled", i)
        lone = F.when(size >= LONG, F.struct(F.get("hashes", i).alias("hash"), (2 * i).alias("place")))
        before, behind = F.get("rolled", i - 1), F.get("rolled", i + 1)
        extreme = (i > 0) & (((own > before) & (own >= behind)) | ((own < before) & (own <= behind)))
        other = F.octet_length(F.get("cut", i - 1))
        two = F.when(extreme & (F.greatest(size, other) < LONG) & (size + other >= SHORT), F.struct(own.alias("hash"), (2 * i - 1).alias("place")))
        return F.array(lone, two)

    return rolled.withColumn("found", F.sort_array(F.filter(F.flatten(F.transform("cut", at)), lambda c: c.isNotNull()))).drop("hashes", "rolled")


def _again(x: Column, k: Column) -> Column:
    """Whether the text has the k-th of its sorted candidates at an earlier place too, byte for byte."""
    before = F.get("found", k - 1)
    same = before["hash"] == x["hash"]
    bytes_of = lambda c: _chunk(F.shiftright(c["place"], 1), c["place"] % 2 == 1)
    return F.coalesce(F.when(same, bytes_of(before) == bytes_of(x)), F.lit(False))


def _places(texts: DataFrame) -> DataFrame:
    """key, id, part, place, again: every place of a candidate; ``key`` is a hash of its hash."""
    places = _candidates(texts).select("id", "part", F.transform("found", lambda c, k: F.struct(
        c["hash"].alias("hash"), c["place"].alias("place"), _again(c, k).alias("again"))).alias("places"))
    # For a plain inline() the optimizer adds a filter that makes the candidates once more, for each of them.
    return places.select("id", "part", F.inline_outer("places")).where(F.col("hash").isNotNull())


def repeats(texts: DataFrame) -> DataFrame:
    """key, first, id, part, place, again: the places of all candidates with several, and the smallest id that has them.

    ``texts`` has id, part and text.
    """
    each = _places(texts)
    groups = each.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where((F.col("n") > 1) & F.col("first").isNotNull())
    # Hashed again both sides go through an exchange of their own, without which Spark splits no skewed partition.
    return each.withColumn("key", F.xxhash64("hash")).drop("hash").join(groups.select(F.xxhash64("hash").alias("key"), "first"), "key")


def _own_bytes(texts: DataFrame, places: DataFrame) -> DataFrame:
    """key and chunk: the bytes at ``places`` (key, id, part, place), each once."""
    wanted = places.groupBy("id", "part").agg(F.collect_set(F.struct("key", "place")).alias("wanted"))
    met = texts.join(wanted, ["id", "part"]).withColumn("cut", lines(F.col("text")))
    found = met.select(F.inline(F.transform("wanted", lambda c: F.struct(
        c["key"].alias("key"), _chunk(F.shiftright(c["place"], 1), c["place"] % 2 == 1).alias("chunk")))))
    return found.where(F.col("chunk").isNotNull()).distinct()


def losses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, lost): places and bytes that a text is to lose, in one row per text; ``part`` hashes it, so that many texts of
    one id, or of none, share no row."""
    texts = _rows(docs, id_col, text_col).select("id", "part", _text(text_col).alias("text"))
    found = kept_table(repeats(texts))
    own = _own_bytes(texts, found.where((F.col("id") == F.col("first")) & ~F.col("again")))
    lost = found.where(F.col("again") | F.col("id").isNull() | (F.col("id") > F.col("first")))
    return lost.join(own, "key").groupBy("id", "part").agg(F.collect_set(F.struct("place", "chunk")).alias("lost"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeats removed from their texts, as ``row``; and n_lines, n_removed (lines)."""
    rows, lost = _rows(docs, id_col, text_col), losses(docs, id_col, text_col)
    met = rows.alias("a").join(lost.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.part") == F.col("b.part")), "left").select("row", "lost")
    cut = met.withColumn("text", _text(text_col)).withColumn("cut", lines(F.col("text")))
    # The bytes decide; another text of the id may have the same ``part``.
    own = F.filter("lost", lambda c: _chunk(F.shiftright(c["place"], 1), c["place"] % 2 == 1) == c["chunk"])
    gone = cut.withColumn("gone", F.when(F.col("lost").isNotNull(), F.flatten(F.transform(own, lambda c: F.sequence(
        F.shiftright(c["place"], 1), F.shiftright(c["place"], 1) + c["place"] % 2)))))
    n = F.size("cut")
    kept = gone.withColumn("kept", F.when((n > 0) & (F.size("gone") > 0), F.array_except(F.sequence(F.lit(0), n - 1), "gone")))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("cut", i)), ""))
    return kept.select(
        F.col("row").withField(f"`{text_col}`", F.when(F.col(f"row.`{text_col}`").isNotNull(), text)).alias("row"),
        n.cast("long").alias("n_lines"), F.coalesce(n - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with repeats removed from their texts."""
    return dedup(docs, id_col, text_col).select("row.*")
