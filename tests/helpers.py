from collections import defaultdict

from pyspark.sql import functions as F


def metrics(result):
    return result.metrics.first()


def row_sets(result):
    """verdict -> set of row ids."""
    sets = defaultdict(set)
    for r in result.participants().select("verdict", "row_id").collect():
        sets[r.verdict].add(r.row_id)
    return dict(sets)


def group_roles(result):
    """(verdict, group key) -> {role or role key: sorted row ids}."""
    found = defaultdict(lambda: defaultdict(list))
    for r in result.participants().collect():
        group = tuple((k.col, k.val) for k in r.group_key)
        role = r.role if r.role_key is None else tuple((k.col, k.val) for k in r.role_key)
        found[r.verdict, group][role].append(r.row_id)
    return {k: {role: sorted(ids) for role, ids in roles.items()} for k, roles in found.items()}


def skewed(spark, n=3000):
    """row_id, k (one key holds a third of the rows), v, t."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row_id"),
        F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), i % 97)).alias("k"),
        F.pmod(i * 7919, F.lit(1013)).alias("v"),
        F.pmod(i * 104729, F.lit(100003)).alias("t"),
    )
