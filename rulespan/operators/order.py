"""Rules about order: monotonic values within a group, and neighbouring rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.model import SATISFACTION, VIOLATION, RuleResult, as_list, key_sql, literal, participant_rows
from rulespan.operators.groups import scoped
from rulespan.operators.metrics import finish, group_counts
from rulespan.operators.skew import find_hot, join_groups, running, stored_if_large

#: Names of the two roles, unless a rule gives its own.
HIGHER = "row with higher position"
LOWER = "row with lower position"


def monotonic(
    df: DataFrame,
    key: str | Sequence[str],
    rank: str,
    value: str,
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    group_verdict: str = "each",
    roles: tuple[str, str] = (HIGHER, LOWER),
    rule_id: str = "monotonic",
) -> RuleResult:
    """Within a group, a strictly higher ``rank`` must come with a strictly higher ``value``.

    ``roles`` names the row of higher and of lower rank.

    The rule is about pairs, but no pair is formed: a row violates in the lower role when some row of
    higher rank has no larger value, which the smallest value above it tells; the other three cases are
    alike. Rows are first folded to (key, rank, value) and (key, rank), so the ordered pass is as long as
    the number of distinct ranks.
    """
    key = as_list(key)
    rows = scoped(df, key, [*key, rank, value], body, row_id, {"_rank": F.col(rank), "_value": F.col(value)})
    upper = df.count()
    values = stored_if_large(
        rows.where("_ok").groupBy(*key, "_rank", "_value").agg(F.count(F.lit(1)).alias("_n")), upper
    )
    ranks = stored_if_large(
        values.groupBy(*key, "_rank").agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi")), upper
    )
    hot = find_hot(ranks, key, upper)
    below = running(ranks, key, ["_rank"], {"lo_below": ("min", "_lo"), "hi_below": ("max", "_hi")}, hot)
    bounds = running(
        below, key, ["_rank"], {"lo_above": ("min", "_lo"), "hi_above": ("max", "_hi")}, hot, descending=True
    ).drop("_lo", "_hi")

    on = [*key, "_rank"]
    flags = {
        "viol_lower": F.col("lo_above") <= F.col("_value"),
        "viol_higher": F.col("hi_below") >= F.col("_value"),
        "sat_lower": F.col("hi_above") > F.col("_value"),
        "sat_higher": F.col("lo_below") < F.col("_value"),
    }
    flags = {name: F.coalesce(test, F.lit(False)) for name, test in flags.items()}

    def with_bounds(part: DataFrame, spread: str) -> DataFrame:
        return join_groups(part, bounds, on, find_hot(part, on, upper), F.col(spread)).withColumns(flags)

    sat, viol = F.col("sat_lower") | F.col("sat_higher"), F.col("viol_lower") | F.col("viol_higher")
    judged = with_bounds(values, "_value")
    groups = judged.groupBy(*key).agg(
        F.sum("_n").alias("all_rows"),
        F.sum(F.when(sat | viol, F.col("_n")).otherwise(F.lit(0))).alias("involved_rows"),
        F.sum(F.when(sat, F.col("_n")).otherwise(F.lit(0))).alias("sat_rows"),
        F.sum(F.when(viol, F.col("_n")).otherwise(F.lit(0))).alias("viol_rows"),
        F.bool_or(sat).alias("sat"),
        F.bool_or(viol).alias("viol"),
    )
    counts = group_counts(groups, group_verdict).drop("total_rows")
    metrics = finish(counts.withColumn("total_rows", F.lit(upper)), rule_id, "group")

    def find(verdicts: Sequence[str]) -> DataFrame:
        case = F.array_compact(
            F.array(
                *[
                    F.when(F.col(flag) & F.lit(v in verdicts), F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("role")))
                    for flag, v, r in (
                        ("sat_lower", SATISFACTION, roles[1]), ("sat_higher", SATISFACTION, roles[0]),
                        ("viol_lower", VIOLATION, roles[1]), ("viol_higher", VIOLATION, roles[0]),
                    )
                ]
            )
        )
        cases = with_bounds(rows.where("_ok").drop("_ok"), "_row").withColumn("_case", F.explode(case))
        return participant_rows(
            cases, literal(rule_id), verdict="_case.verdict", group_key=key_sql(key), role="_case.role"
        )

    return RuleResult(rule_id, "group", metrics, find, groups.where("sat or viol"))


#: Links of a bundle, and members of a piece: a bundle and a piece that meet make at most 524,288 pairs.
BUNDLE = 128
PIECE = 4096


@dataclass(frozen=True)
class PairList:
    """Pairs of a monotonic rule, without forming them.

    ``members``: group_key, block, place, row_id: the rows of each block in an order. ``links``: group_key, row_id (the row of
    lower rank), block, first, last: it makes a pair with every member of the block at the places ``first`` to ``last``;
    number: the links of a block in the order of these places.
    """

    links: DataFrame
    members: DataFrame

    def pairs(self, key: Column | str = "group_key") -> DataFrame:
        """group_key, lower, higher: all pairs, expanded; as many rows as there are pairs.

        ``key`` is what to show as group_key. It is evaluated for a bundle of links, not for each pair.
        Bundles of links meet pieces of their block, each an array of a bounded length, and only the places that a link
        names are read off the piece, so nothing is made and thrown away. What meets is dealt out evenly: a hot group is
        no one task's.
        """
        on = ["group_key", "block"]
        pieces = self.members.groupBy(*on, F.expr(f"place div {PIECE}").alias("piece")).agg(
            F.sort_array(F.collect_list(F.struct("place", "row_id"))).alias("_found")
        ).select(*on, "piece", F.col("_found.row_id").alias("_ids"))
        bundles = self.links.groupBy(*on, F.expr(f"number div {BUNDLE}").alias("bundle")).agg(
            F.collect_list(F.struct("row_id", "first", "last")).alias("_links"),
            F.min(F.expr(f"first div {PIECE}")).alias("_from"), F.max(F.expr(f"last div {PIECE}")).alias("_to"),
        )
        meeting = bundles.withColumn("piece", F.explode(F.sequence("_from", "_to"))).join(pieces, [*on, "piece"])
        spark = self.links.sparkSession
        # A number, as what a task makes of its rows can't be seen from their size.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        base = F.col("piece") * PIECE
        shown = F.expr(key) if isinstance(key, str) else key
        dealt = meeting.select(shown.alias("group_key"), base.alias("_base"), "_links", "_ids").repartition(tasks)
        low, high = F.greatest(F.col("_link.first") - F.col("_base"), F.lit(0)), F.least(F.col("_link.last") - F.col("_base"), F.lit(PIECE - 1))
        each = dealt.select("group_key", "_base", "_ids", F.explode("_links").alias("_link")).where(low <= high).select(
            "group_key", F.col("_link.row_id").alias("lower"), F.slice("_ids", low.cast("int") + 1, (high - low).cast("int") + 1).alias("_some"))
        # Compiled as one, both explodes would keep all pairs of a bundle in memory before the first is passed on; as many
        # partitions as before is a step that is not compiled, so a link's pairs are passed on before the next link's are made.
        return each.coalesce(tasks).select("group_key", "lower", F.explode("_some").alias("higher"))

    def count(self) -> DataFrame:
        """One row: how many pairs there are, from the links alone."""
        return self.links.agg(F.coalesce(F.sum((F.col("last") - F.col("first") + 1).cast("decimal(38,0)")), F.lit(0)).alias("pairs"))


def monotonic_pairs(
    df: DataFrame,
    key: str | Sequence[str],
    rank: str,
    value: str,
    verdict: str = VIOLATION,
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    levels: int = 40,
) -> PairList:
    """Which pairs of a monotonic rule satisfy or violate it, as links from rows to parts of blocks.

    The ranks of a group are numbered and dealt to blocks of 1, 2, 4, ... neighbours. Above a row's rank lie at most one
    block of each width, its sibling; in a block rows are ordered by value, so those the row makes a pair with are the
    first ones (violations) or the last ones. n rows give at most n log n memberships and links, however many pairs they stand
    for; only links with a pair are kept. ``levels`` bounds log2 of a group's ranks.
    """
    key = as_list(key)
    rows = scoped(df, key, [*key, rank, value], body, row_id, {"_rank": F.col(rank), "_value": F.col(value)}).where("_ok").drop("_ok")
    ranks = rows.groupBy(*key, "_rank").agg(F.lit(1).alias("_one"))
    numbered = running(ranks, key, ["_rank"], {"_at": ("sum", "_one")}, find_hot(ranks, key)).select(*key, "_rank", F.col("_at").cast("long").alias("_at"))
    most = numbered.groupBy(*key).agg(F.ceil(F.log2(F.max("_at") + 1)).cast("int").alias("_top"))
    placed = join_groups(rows, numbered.join(most, key), [*key, "_rank"], find_hot(rows, [*key, "_rank"]), F.col("_row"))
    # Blocks at level w are ranks with the same number >> w. A row is a member of its own block at every level below the
    # top, and asks the sibling above where its own block is the lower one of two.
    each = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.least(F.greatest("_top", F.lit(1)), F.lit(levels)) - 1)))
    own = F.expr("shiftright(_at, _level)")
    member = each.select(*key, "_level", own.alias("_block"), "_value", F.lit(0).alias("_asks"), "_row", F.lit(1).alias("_n"))
    asks = each.where(own % 2 == 0).select(*key, "_level", (own + 1).alias("_block"), "_value", F.lit(1).alias("_asks"), "_row", F.lit(0).alias("_n"))
    events = member.unionByName(asks)
    block = [*key, "_level", "_block"]
    # Members of an equal value come before the question: they are not strictly larger.
    counted = running(events, block, ["_value", "_asks", "_row"], {"_before": ("sum", "_n"), "_number": ("sum", "_asks")}, find_hot(events, block))
    name = F.struct("_level", "_block").alias("block")
    group = F.expr(key_sql(key)).alias("group_key")
    place, number = F.col("_before").cast("long"), F.col("_number").cast("long").alias("number")
    members = counted.where("_asks = 0").select(group, name, place.alias("place"), F.col("_row").alias("row_id"))
    asked = counted.where("_asks = 1")
    if verdict == VIOLATION:
        links = asked.where("_before > 0").select(group, F.col("_row").alias("row_id"), name, F.lit(0).cast("long").alias("first"), (place - 1).alias("last"), number)
    else:
        sizes = member.groupBy(*block).agg(F.count(F.lit(1)).alias("_size"))
        sized = join_groups(asked, sizes, block, find_hot(asked, block), F.col("_row"))
        links = sized.where("_before < _size").select(group, F.col("_row").alias("row_id"), name, place.alias("first"), (F.col("_size") - 1).alias("last"), number)
    return PairList(links, members)


def sequence_rule(
    df: DataFrame,
    partition: str | Sequence[str],
    order: str | Sequence[str],
    head: Callable[[Column, Column], Column],
    cols: str | Sequence[str],
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    rule_id: str = "sequence_rule",
) -> RuleResult:
    """Neighbouring rows of a partition must fulfil ``head(previous, current)``.

    ``head`` sees structs of ``cols``; ``order`` must be unique within a partition. Every pair of
    neighbours is one set of two rows; a row is in up to two sets.
    """
    partition, order, cols = as_list(partition), as_list(order), as_list(cols)
    rows = scoped(
        df, partition, [*partition, *order, *cols], body, row_id,
        {**{f"_o{i}": F.col(c) for i, c in enumerate(order)}, "_item": F.struct(*cols)},
    )
    by = [f"_o{i}" for i in range(len(order))]
    packed = rows.where("_ok").drop("_ok").withColumn("_seen", F.struct("_item", "_row"))
    upper = df.count()
    neighbours = {"_prev": ("previous", "_seen"), "_next": ("next", "_seen")}
    linked = running(packed, partition, by, neighbours, find_hot(packed, partition, upper))
    # NULL where there is no neighbour, so a row at the edge of its partition is in one pair only.
    before = F.when(
        F.col("_prev").isNotNull(), F.coalesce(head(F.col("_prev._item"), F.col("_item")), F.lit(False))
    )
    after = F.when(
        F.col("_next").isNotNull(), F.coalesce(head(F.col("_item"), F.col("_next._item")), F.lit(False))
    )
    judged = linked.select("_row", "_prev", before.alias("_before"), after.alias("_after"))
    either = F.array_compact(F.array("_before", "_after"))
    counts = judged.agg(
        F.count_if(F.size(either) > 0).alias("applicable_rows"),
        F.count_if(F.array_contains(either, True)).alias("sat_rows"),
        F.count_if(F.array_contains(either, False)).alias("viol_rows"),
        F.count_if("_before").alias("sat_groups"),
        F.count_if(~F.col("_before")).alias("viol_groups"),
    )
    metrics = finish(counts.withColumn("total_rows", F.lit(upper)), rule_id, "pair")

    def find(verdicts: Sequence[str]) -> DataFrame:
        verdict = F.when(F.col("_before"), F.lit(SATISFACTION)).otherwise(F.lit(VIOLATION))
        members = judged.where(F.col("_before").isNotNull()).select(
            verdict.alias("_verdict"),
            F.col("_row").alias("_pair"),
            F.inline(
                F.array(
                    F.struct(F.lit("previous").alias("_role"), F.col("_prev._row").alias("_member")),
                    F.struct(F.lit("current").alias("_role"), F.col("_row").alias("_member")),
                )
            ),
        )
        return participant_rows(
            members.where(F.col("_verdict").isin(*verdicts)), literal(rule_id), verdict="_verdict",
            row="_member", rep_id="_pair", role="_role",
        )

    return RuleResult(rule_id, "pair", metrics, find)
