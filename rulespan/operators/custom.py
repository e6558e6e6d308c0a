"""Rules written as user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions.prep import exclude_nulls
from rulespan.model import (
    SATISFACTION,
    VIOLATION,
    RuleResult,
    as_list,
    key_sql,
    literal,
    participant_rows,
    row_id_column,
)
from rulespan.operators.metrics import finish, group_counts, metrics_of
from rulespan.operators.skew import find_hot, join_groups

Tables = DataFrame | Mapping[str, DataFrame]


def custom_rule(
    fn: Callable[[Tables], DataFrame],
    tables: Tables,
    *,
    primary: str | None = None,
    rule_class: str = "group",
    rule_id: str = "custom_rule",
) -> RuleResult:
    """Any rule as a function from a DataFrame, or a table set, to a participant table.

    The function must return ``verdict`` and ``row_id``; further participant columns are optional.
    ``primary`` names the table of a set whose rows the verdicts are about.
    """
    found = fn(tables)
    lacking = {"verdict", "row_id"} - set(found.columns)
    if lacking:
        raise ValueError(f"a custom rule must return the columns verdict and row_id; missing {sorted(lacking)}")
    given = {"verdict": "verdict", "row": "row_id"}
    given |= {c: c for c in ("group_key", "rep_id", "role", "role_key") if c in found.columns}
    full = participant_rows(found, literal(rule_id), **given)
    base = tables if isinstance(tables, DataFrame) else tables[primary]
    metrics = metrics_of(full, base, rule_id, rule_class)
    return RuleResult(rule_id, rule_class, metrics, lambda verdicts: full.where(F.col("verdict").isin(*verdicts)))


def pandas_group_rule(
    df: DataFrame,
    key: str | Sequence[str],
    cols: Sequence[str],
    summarise: Callable[[pd.DataFrame], dict],
    combine: Callable[[pd.DataFrame], dict],
    judge: Callable[[dict], bool],
    state: str,
    *,
    row_id: str | Sequence[str],
    rule_id: str = "pandas_group_rule",
) -> RuleResult:
    """A group rule in pandas that never sees a whole group at once.

    ``summarise`` turns some rows of one group into a state of fixed size (fields as in the DDL string
    ``state``); ``combine`` turns several states (a frame with those fields) into one; ``judge`` decides
    from the state of the full group. Rows are shuffled by key and streamed in key order, batch by batch.
    A hot group is first dealt over several tasks, whose states meet in a second step.
    """
    key = as_list(key)
    fields = T._parse_datatype_string(state) if isinstance(state, str) else state
    names = [f.name for f in fields]
    needed = [*key, *[c for c in cols if c not in key]]
    rows = exclude_nulls(df.select(*needed, row_id_column(row_id).alias("_row")), needed)
    key_fields = [df.schema[c] for c in key]
    state_schema = T.StructType([*key_fields, *fields, T.StructField("_n", T.LongType())])
    by = key[0] if len(key) == 1 else key

    def tuple_of(group) -> tuple:
        return group if isinstance(group, tuple) else (group,)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, part in batch.groupby(by, sort=False):
                found = summarise(part)
                out.append((*tuple_of(group), *[found[n] for n in names], len(part)))
            yield pd.DataFrame(out, columns=[*key, *names, "_n"])

    def merged(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One state per group, from frames in key order: only the last group of a frame can go on."""
        pending = None
        for frame in states:
            if frame.empty:
                continue
            frame = frame[[*key, *names, "_n"]]
            if pending is not None:
                frame = pd.concat([pending, frame], ignore_index=True)
            if frame.duplicated(key).any():
                out = []
                for group, part in frame.groupby(by, sort=False):
                    one = combine(part[names]) if len(part) > 1 else part.iloc[0]
                    out.append((*tuple_of(group), *[one[n] for n in names], part["_n"].sum()))
                frame = pd.DataFrame(out, columns=frame.columns)
            pending = frame.iloc[[-1]]
            if len(frame) > 1:
                yield frame.iloc[:-1]
        if pending is not None:
            yield pending

    def judged(states: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in merged(states):
            holds = [bool(judge(state)) for state in frame[names].to_dict("records")]
            yield frame[[*key, "_n"]].assign(_holds=holds)

    total = df.count()
    hot = find_hot(rows, key, total)
    verdict_schema = T.StructType(
        [*key_fields, T.StructField("_n", T.LongType()), T.StructField("_holds", T.BooleanType())]
    )
    # Python work is heavier than its bytes suggest, so the number of tasks is set and not coalesced.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot is None:
        ordered = rows.select(*needed).repartition(tasks, *key).sortWithinPartitions(*key)
        verdicts_of = ordered.mapInPandas(lambda batches: judged(summaries(batches)), verdict_schema)
    else:
        salt = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0))
        salted = rows.join(hot.hinted(), key, "left").select(*needed, salt.alias("_salt"))
        ordered = salted.repartition(tasks, *key, "_salt").sortWithinPartitions(*key).drop("_salt")
        states = ordered.mapInPandas(lambda batches: merged(summaries(batches)), state_schema)
        verdicts_of = states.repartition(tasks, *key).sortWithinPartitions(*key).mapInPandas(judged, verdict_schema)
    holds = F.col("_holds")
    groups = verdicts_of.select(
        *key,
        F.when(holds, F.lit(SATISFACTION)).otherwise(F.lit(VIOLATION)).alias("verdict"),
        F.col("_n").alias("all_rows"),
        F.col("_n").alias("involved_rows"),
        F.when(holds, F.col("_n")).otherwise(F.lit(0)).alias("sat_rows"),
        F.when(~holds, F.col("_n")).otherwise(F.lit(0)).alias("viol_rows"),
        holds.alias("sat"),
        (~holds).alias("viol"),
    )
    metrics = finish(group_counts(groups).withColumn("total_rows", F.lit(total)), rule_id, "group")

    def find(verdicts: Sequence[str]) -> DataFrame:
        wanted = groups.where(F.col("verdict").isin(*verdicts)).select(*key, "verdict")
        joined = join_groups(rows, wanted, key, hot, F.col("_row"))
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="0", role="'group'"
        )

    return RuleResult(rule_id, "group", metrics, find, groups)
