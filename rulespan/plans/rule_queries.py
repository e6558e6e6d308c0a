"""Registered rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.functions.prep import exclude_nulls
from rulespan.model import SATISFACTION, VIOLATION, RuleResult
from rulespan.operators import custom, groups, order, outliers, pairs, rows, tables
from rulespan.plans.batch import RuleSpec, metrics_plan
from rulespan.plans.registry import (
    Tables,
    group_sql,
    key_sql,
    key_text,
    metrics_out,
    metrics_sql,
    query,
    row_sql,
    verdict_sql,
)

#: Amounts in checks of sums are exact to six places on both sides.
MONEY = "decimal(28,6)"
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_COLUMNS = ", ".join(LINE_ID)


def line_rows(participants: DataFrame, *more) -> DataFrame:
    return participants.select("row_id.*", "verdict", *more)


# ---- row rules -------------------------------------------------------------------------------------------


def conditional(t: Tables) -> RuleResult:
    return rows.row_rule(
        t.lineitem, "l_discount <= 0.05", "l_quantity > 40", row_id=LINE_ID,
        cols=["l_discount", "l_quantity"], rule_id="row_conditional",
    )


@query("row_conditional", row_sql("row_conditional", "lineitem", "l_discount <= 0.05", "l_quantity > 40"))
def _(t: Tables) -> DataFrame:
    return metrics_out(conditional(t))


@query(
    "row_conditional_rows",
    f"SELECT {LINE_COLUMNS}, {verdict_sql('l_discount <= 0.05')} AS verdict FROM lineitem WHERE l_quantity > 40",
)
def _(t: Tables) -> DataFrame:
    return line_rows(conditional(t).participants())


@query("row_unconditional", row_sql("row_unconditional", "customer", "c_acctbal >= 0"))
def _(t: Tables) -> DataFrame:
    return metrics_out(rows.row_rule(t.customer, "c_acctbal >= 0", row_id="c_custkey", cols="c_acctbal", rule_id="row_unconditional"))


def labelled(t: Tables) -> DataFrame:
    """Documents with their labels, NULL where there are none: the table with missing values."""
    return t.documents.join(t.labels, "doc_id", "left")


LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("row_not_null", row_sql("row_not_null", f"{LABELLED} x", "quality IS NOT NULL"))
def _(t: Tables) -> DataFrame:
    return metrics_out(rows.not_null_rule(labelled(t), "quality", row_id="doc_id", rule_id="row_not_null"))


@query("row_pattern", row_sql("row_pattern", "pages", "regexp_matches(url, '^https://')"))
def _(t: Tables) -> DataFrame:
    return metrics_out(rows.pattern_rule(t.pages, "url", "^https://", row_id="page_id", rule_id="row_pattern"))


@query(
    "row_pattern_rows",
    f"SELECT page_id AS row_id, {verdict_sql('''regexp_matches(url, '^https://')''')} AS verdict FROM pages",
)
def _(t: Tables) -> DataFrame:
    result = rows.pattern_rule(t.pages, "url", "^https://", row_id="page_id")
    return result.participants().select("row_id", "verdict")


@query("row_support_satisfied", row_sql("row_support_satisfied", "lineitem", "l_discount <= 0.05", "l_quantity > 40").replace(
    "applicable_rows::DOUBLE / total_rows", "sat_rows::DOUBLE / total_rows"))
def _(t: Tables) -> DataFrame:
    result = rows.row_rule(
        t.lineitem, "l_discount <= 0.05", "l_quantity > 40", row_id=LINE_ID,
        rule_id="row_support_satisfied", support_mode="satisfied",
    )
    return metrics_out(result)


SHARED = [
    ("qty_positive", "l_quantity > 0", None),
    ("bulk_discount", "l_discount <= 0.05", "l_quantity > 40"),
    ("open_lines_late", "l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'", "l_linestatus = 'O'"),
    ("tax_below_discount", "l_tax <= l_discount", "l_returnflag = 'R'"),
]


@query("row_rules_shared_scan", " UNION ALL ".join(
    f"({row_sql(name, 'lineitem', head, body or 'TRUE')})" for name, head, body in SHARED))
def _(t: Tables) -> DataFrame:
    rules = [rows.RowRule(name, head.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), body) for name, head, body in SHARED]
    return metrics_out(rows.evaluate_row_rules(t.lineitem, rules, row_id=LINE_ID).metrics)


@query("row_rules_shared_scan_rows", " UNION ALL ".join(
    f"SELECT '{name}' AS rule_id, {LINE_COLUMNS}, {verdict_sql(head)} AS verdict FROM lineitem WHERE {body or 'TRUE'}"
    for name, head, body in SHARED))
def _(t: Tables) -> DataFrame:
    rules = [rows.RowRule(name, head.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), body) for name, head, body in SHARED]
    return line_rows(rows.evaluate_row_rules(t.lineitem, rules, row_id=LINE_ID).participants, "rule_id")


# ---- keys and dependencies -------------------------------------------------------------------------------


@query("unique_key", group_sql(
    "unique_key", "SELECT count(*) AS n, count(*) = 1 AS ok FROM lineitem GROUP BY l_orderkey, l_linenumber", "lineitem"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], row_id=LINE_ID, rule_id="unique_key"))


@query("unique_key_rows", f"""
    SELECT {LINE_COLUMNS}, {verdict_sql('n = 1')} AS verdict,
      CASE WHEN n = 1 THEN 'unique_record' ELSE 'duplicates' END AS role,
      {key_sql('l_orderkey', 'l_linenumber')} AS group_key
    FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    result = groups.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], row_id=LINE_ID)
    return line_rows(result.participants(), "role", key_text().alias("group_key"))


def digested(t: Tables) -> DataFrame:
    """Documents under a digest of the text, so that long texts are not what is shuffled."""
    return t.documents.withColumn("text_digest", F.sha2("text", 256))


@query("unique_text", group_sql(
    "unique_text", "SELECT count(*) AS n, count(*) = 1 AS ok FROM documents GROUP BY text", "documents"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.unique_key(digested(t), "text_digest", row_id="doc_id", rule_id="unique_text"))


def part_fd(t: Tables, rule_id: str = "fd") -> RuleResult:
    return groups.functional_dependency(t.part, ["p_name", "p_brand"], "p_type", row_id="p_partkey", rule_id=rule_id)


def fd_sql(rule_id: str, table: str, lhs: str, rhs: str, body: str = "TRUE") -> str:
    inner = f"SELECT count(*) AS n, count(DISTINCT ({rhs})) = 1 AS ok FROM {table} WHERE {body} GROUP BY {lhs}"
    return group_sql(rule_id, inner, table)


@query("fd", fd_sql("fd", "part", "p_name, p_brand", "p_type"))
def _(t: Tables) -> DataFrame:
    return metrics_out(part_fd(t))


FD_ROWS = f"""
    SELECT p.p_partkey AS row_id, {verdict_sql('g.kinds = 1')} AS verdict,
      {key_sql('p_name', 'p_brand')} AS group_key, {key_sql('p_type')} AS role_key
    FROM part p JOIN (SELECT p_name, p_brand, count(DISTINCT p_type) AS kinds FROM part GROUP BY ALL) g
      USING (p_name, p_brand)"""


@query("fd_rows", FD_ROWS)
def _(t: Tables) -> DataFrame:
    found = part_fd(t).participants()
    return found.select("row_id", "verdict", key_text().alias("group_key"), key_text("role_key").alias("role_key"))


@query("fd_multi_rhs", fd_sql("fd_multi_rhs", "part", "p_name, p_brand, p_size", "p_type, p_retailprice"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.functional_dependency(
        t.part, ["p_name", "p_brand", "p_size"], ["p_type", "p_retailprice"], row_id="p_partkey", rule_id="fd_multi_rhs"))


@query("fd_within", fd_sql("fd_within", "orders", "o_orderpriority, o_custkey", "o_orderstatus"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.functional_dependency(
        t.orders, "o_custkey", "o_orderstatus", within="o_orderpriority", row_id="o_orderkey", rule_id="fd_within"))


@query("fd_conditional", fd_sql("fd_conditional", "part", "p_name, p_brand", "p_type", "p_size > 40"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.functional_dependency(
        t.part, ["p_name", "p_brand"], "p_type", body="p_size > 40", row_id="p_partkey", rule_id="fd_conditional"))


@query("unique_conditional", group_sql(
    "unique_conditional",
    "SELECT count(*) AS n, count(*) = 1 AS ok FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey", "lineitem"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.unique_key(
        t.lineitem, "l_orderkey", body="l_returnflag = 'R'", row_id=LINE_ID, rule_id="unique_conditional"))


@query("null_exclusion", group_sql(
    "null_exclusion",
    f"SELECT count(*) AS n, count(DISTINCT quality) = 1 AS ok FROM {LABELLED} x WHERE quality IS NOT NULL GROUP BY lang",
    "documents"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.functional_dependency(labelled(t), "lang", "quality", row_id="doc_id", rule_id="null_exclusion"))


@query("exclude_nulls", f"SELECT doc_id, lang, quality, toxic FROM {LABELLED} x WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return exclude_nulls(labelled(t), ["quality", "toxic"]).select("doc_id", "lang", "quality", "toxic")


# ---- sums and aggregates ---------------------------------------------------------------------------------

EVENT_SUMS = """
    SELECT user_id,
      sum(value::DECIMAL(28,6)) FILTER (WHERE event_type IN ('click','view')) AS part,
      sum(value::DECIMAL(28,6)) FILTER (WHERE event_type IN ('purchase','signup')) AS total,
      count(*) FILTER (WHERE event_type IN ('click','view','purchase','signup')) AS n
    FROM events GROUP BY user_id"""


def event_totals(t: Tables) -> RuleResult:
    return groups.sum_to_total(
        t.events, "user_id", "value", "event_type in ('click','view')", "event_type in ('purchase','signup')", "<=",
        row_id="event_id", scale=6, rule_id="sum_to_total")


@query("sum_to_total", group_sql("sum_to_total", f"SELECT n, part <= total AS ok FROM ({EVENT_SUMS})", "events"))
def _(t: Tables) -> DataFrame:
    return metrics_out(event_totals(t))


@query("sum_to_total_rows", f"""
    SELECT event_id AS row_id, {verdict_sql('part <= total')} AS verdict,
      CASE WHEN event_type IN ('click','view') THEN 'sum' ELSE 'compare' END AS role, {key_sql('user_id')} AS group_key
    FROM events JOIN ({EVENT_SUMS}) USING (user_id)
    WHERE event_type IN ('click','view','purchase','signup') AND part IS NOT NULL AND total IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return event_totals(t).participants().select("row_id", "verdict", "role", key_text().alias("group_key"))


WEEKS = """
    SELECT user_id, date_trunc('week', ts) AS w, count(*) AS n, sum(value::DECIMAL(28,6)) <= 500 AS ok
    FROM events GROUP BY ALL"""


def weekly(t: Tables) -> RuleResult:
    return groups.sum_to_threshold(
        t.events, "user_id", "value", "<=", 500, window=("ts", "week"), row_id="event_id", scale=6, rule_id="sum_to_threshold")


@query("sum_to_threshold", metrics_sql(
    "sum_to_threshold", "group",
    """SELECT (SELECT count(*) FROM events) AS total_rows, sum(s + v) AS applicable_rows, sum(s) AS sat_rows,
      sum(v) AS viol_rows, count(*) FILTER (WHERE sat) AS sat_groups, count(*) FILTER (WHERE viol) AS viol_groups FROM g""",
    f"""g AS (SELECT user_id, sum(CASE WHEN ok THEN n ELSE 0 END) AS s, sum(CASE WHEN ok THEN 0 ELSE n END) AS v,
      bool_or(ok) AS sat, bool_or(NOT ok) AS viol FROM ({WEEKS}) GROUP BY user_id)"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(weekly(t))


@query("sum_to_threshold_rows", f"""
    SELECT e.event_id AS row_id, {verdict_sql('g.ok')} AS verdict, strftime(g.w, '%Y-%m-%d') AS week, {key_sql('user_id')} AS group_key
    FROM events e JOIN ({WEEKS}) g USING (user_id) WHERE date_trunc('week', e.ts) = g.w""")
def _(t: Tables) -> DataFrame:
    found = weekly(t).participants()
    return found.select("row_id", "verdict", F.substring("rep_id", 1, 10).alias("week"), key_text().alias("group_key"))


@query("aggregate_constraint", group_sql(
    "aggregate_constraint", "SELECT count(*) AS n, count(*) BETWEEN 5 AND 12 AS ok FROM orders GROUP BY o_custkey", "orders"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.aggregate_constraint(
        t.orders, "o_custkey", "count", lambda n: n.between(5, 12), row_id="o_orderkey", rule_id="aggregate_constraint"))


@query("aggregate_constraint_sum", group_sql(
    "aggregate_constraint_sum",
    "SELECT count(*) AS n, sum(l_quantity::DECIMAL(28,6)) <= 150 AS ok FROM lineitem GROUP BY l_orderkey", "lineitem"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.aggregate_constraint(
        t.lineitem, "l_orderkey", "sum", "agg_value <= 150", "l_quantity", row_id=LINE_ID, rule_id="aggregate_constraint_sum"))


@query("aggregate_constraint_distinct", group_sql(
    "aggregate_constraint_distinct",
    "SELECT count(*) AS n, count(DISTINCT l_suppkey) >= 3 AS ok FROM lineitem GROUP BY l_orderkey", "lineitem"))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.aggregate_constraint(
        t.lineitem, "l_orderkey", "count_distinct", "agg_value >= 3", "l_suppkey", row_id=LINE_ID,
        rule_id="aggregate_constraint_distinct"))


SHARED_GROUPS = [
    groups.GroupRule("lines_unique", "count", "agg_value = 1"),
    groups.GroupRule("few_lines", "count", "agg_value between 2 and 5"),
    groups.GroupRule("small_sum", "sum", "agg_value <= 150", "l_quantity"),
    groups.GroupRule("several_suppliers", "count_distinct", "agg_value >= 3", "l_suppkey"),
    groups.GroupRule("returned_discount", "max", "agg_value < 0.1", "l_discount", "l_returnflag = 'R'"),
]
SHARED_TESTS = {
    "lines_unique": "count(*) = 1", "few_lines": "count(*) BETWEEN 2 AND 5", "small_sum": "sum(l_quantity::DECIMAL(28,6)) <= 150",
    "several_suppliers": "count(DISTINCT l_suppkey) >= 3", "returned_discount": "max(l_discount) < 0.1"}


@query("group_rules_shared_shuffle", " UNION ALL ".join(
    "(" + group_sql(r.rule_id, f"SELECT count(*) AS n, {SHARED_TESTS[r.rule_id]} AS ok FROM lineitem WHERE {r.body or 'TRUE'} GROUP BY l_orderkey", "lineitem") + ")"
    for r in SHARED_GROUPS))
def _(t: Tables) -> DataFrame:
    return metrics_out(groups.evaluate_group_rules(t.lineitem, "l_orderkey", SHARED_GROUPS))


# ---- order -----------------------------------------------------------------------------------------------

PAIR_FLAGS = """
    SELECT a.p_brand, a.p_partkey AS hi, b.p_partkey AS lo, a.p_retailprice > b.p_retailprice AS ok
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size > b.p_size"""


def by_size(t: Tables) -> RuleResult:
    return order.monotonic(t.part, "p_brand", "p_size", "p_retailprice", row_id="p_partkey", rule_id="monotonic")


@query("monotonic", metrics_sql(
    "monotonic", "group",
    """SELECT (SELECT count(*) FROM part) AS total_rows, (SELECT count(DISTINCT k) FROM m) AS applicable_rows,
      (SELECT count(DISTINCT k) FROM m WHERE ok) AS sat_rows, (SELECT count(DISTINCT k) FROM m WHERE NOT ok) AS viol_rows,
      (SELECT count(DISTINCT p_brand) FROM m WHERE ok) AS sat_groups,
      (SELECT count(DISTINCT p_brand) FROM m WHERE NOT ok) AS viol_groups""",
    f"""p AS ({PAIR_FLAGS}),
      m AS (SELECT DISTINCT p_brand, hi AS k, ok FROM p UNION SELECT DISTINCT p_brand, lo, ok FROM p)"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(by_size(t))


@query("monotonic_rows", f"""
    WITH p AS ({PAIR_FLAGS})
    SELECT DISTINCT hi AS row_id, {verdict_sql('ok')} AS verdict, 'row with higher position' AS role FROM p
    UNION ALL SELECT DISTINCT lo, {verdict_sql('ok')}, 'row with lower position' FROM p""")
def _(t: Tables) -> DataFrame:
    return by_size(t).participants().select("row_id", "verdict", "role")


def size_pairs(t: Tables, verdict: str) -> order.PairList:
    return order.monotonic_pairs(t.part, "p_brand", "p_size", "p_retailprice", verdict, row_id="p_partkey")


@query("monotonic_pairs", f"SELECT {key_sql('p_brand')} AS group_key, lo AS lower, hi AS higher FROM ({PAIR_FLAGS}) WHERE NOT ok")
def _(t: Tables) -> DataFrame:
    return size_pairs(t, VIOLATION).pairs(key_text())


@query("monotonic_pair_counts", f"""
    SELECT 'violation' AS verdict, count(*) FILTER (WHERE NOT ok) AS pairs FROM ({PAIR_FLAGS})
    UNION ALL SELECT 'satisfaction', count(*) FILTER (WHERE ok) FROM ({PAIR_FLAGS})""")
def _(t: Tables) -> DataFrame:
    one, two = (size_pairs(t, v).count().select(F.lit(v).alias("verdict"), F.col("pairs").cast("long").alias("pairs")) for v in (VIOLATION, SATISFACTION))
    return one.unionAll(two)


NEIGHBOURS = """
    SELECT event_id, lag(event_id) OVER w AS prev, event_type <> lag(event_type) OVER w AS ok
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def event_order(t: Tables) -> RuleResult:
    return order.sequence_rule(
        t.events, "user_id", ["ts", "event_id"], lambda a, b: a["event_type"] != b["event_type"], "event_type",
        row_id="event_id", rule_id="sequence_rule")


@query("sequence_rule", metrics_sql(
    "sequence_rule", "pair",
    """SELECT (SELECT count(*) FROM events) AS total_rows, (SELECT count(DISTINCT k) FROM m) AS applicable_rows,
      (SELECT count(DISTINCT k) FROM m WHERE ok) AS sat_rows, (SELECT count(DISTINCT k) FROM m WHERE NOT ok) AS viol_rows,
      (SELECT count(*) FROM p WHERE ok) AS sat_groups, (SELECT count(*) FROM p WHERE NOT ok) AS viol_groups""",
    f"""p AS (SELECT * FROM ({NEIGHBOURS}) WHERE prev IS NOT NULL),
      m AS (SELECT event_id AS k, ok FROM p UNION ALL SELECT prev, ok FROM p)"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(event_order(t))


@query("sequence_rule_rows", f"""
    WITH p AS (SELECT * FROM ({NEIGHBOURS}) WHERE prev IS NOT NULL)
    SELECT event_id::VARCHAR AS rep_id, event_id AS row_id, 'current' AS role, {verdict_sql('ok')} AS verdict FROM p
    UNION ALL SELECT event_id::VARCHAR, prev, 'previous', {verdict_sql('ok')} FROM p""")
def _(t: Tables) -> DataFrame:
    return event_order(t).participants().select("rep_id", "row_id", "role", "verdict")


# ---- outliers --------------------------------------------------------------------------------------------

ZSCORE = """
    SELECT event_id, event_type, abs(value - m) > 3 * s AS bad FROM events
    JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) USING (event_type)"""
IQR = """
    SELECT event_id, event_type, value > q3 + 1.5 * (q3 - q1) AS bad FROM events
    JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
      USING (event_type)"""


def outlier_sql(rule_id: str, judged: str) -> str:
    return metrics_sql(
        rule_id, "group",
        """SELECT (SELECT count(*) FROM events) AS total_rows, sum(n) AS applicable_rows, sum(n - b) AS sat_rows,
          sum(b) AS viol_rows, count(*) FILTER (WHERE b < n) AS sat_groups, count(*) FILTER (WHERE b > 0) AS viol_groups
          FROM g""",
        f"g AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE bad) AS b FROM ({judged}) GROUP BY 1)")


def outlier_rows_sql(judged: str) -> str:
    return f"""SELECT event_id AS row_id, {verdict_sql('NOT bad')} AS verdict,
      CASE WHEN bad THEN 'outliers' ELSE 'inliers' END AS role, {key_sql('event_type')} AS group_key FROM ({judged})"""


def zscore(t: Tables) -> RuleResult:
    return outliers.outlier(t.events, "event_type", "value", "zscore", 3.0, row_id="event_id", rule_id="outlier_zscore")


def iqr(t: Tables) -> RuleResult:
    return outliers.outlier(t.events, "event_type", "value", "iqr", 1.5, "upper", row_id="event_id", rule_id="outlier_iqr")


@query("outlier_zscore", outlier_sql("outlier_zscore", ZSCORE))
def _(t: Tables) -> DataFrame:
    return metrics_out(zscore(t))


@query("outlier_zscore_rows", outlier_rows_sql(ZSCORE))
def _(t: Tables) -> DataFrame:
    return zscore(t).participants().select("row_id", "verdict", "role", key_text().alias("group_key"))


@query("outlier_iqr", outlier_sql("outlier_iqr", IQR))
def _(t: Tables) -> DataFrame:
    return metrics_out(iqr(t))


@query("outlier_iqr_rows", outlier_rows_sql(IQR))
def _(t: Tables) -> DataFrame:
    return iqr(t).participants().select("row_id", "verdict", "role", key_text().alias("group_key"))


# ---- pairs -----------------------------------------------------------------------------------------------

TEXT_PAIRS = """
    SELECT a.doc_id AS x, b.doc_id AS y, a.source = b.source AS ok
    FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id"""


def copies(t: Tables) -> RuleResult:
    return pairs.pair_rule(digested(t), "text_digest", "source", row_id="doc_id", rule_id="pair_rule")


@query("pair_rule", metrics_sql(
    "pair_rule", "pair",
    """SELECT (SELECT count(*) FROM documents) AS total_rows, (SELECT count(DISTINCT k) FROM m) AS applicable_rows,
      (SELECT count(DISTINCT k) FROM m WHERE ok) AS sat_rows, (SELECT count(DISTINCT k) FROM m WHERE NOT ok) AS viol_rows,
      (SELECT count(*) FROM p WHERE ok) AS sat_groups, (SELECT count(*) FROM p WHERE NOT ok) AS viol_groups""",
    f"p AS ({TEXT_PAIRS}), m AS (SELECT x AS k, ok FROM p UNION ALL SELECT y, ok FROM p)"))
def _(t: Tables) -> DataFrame:
    return metrics_out(copies(t))


@query("pair_rule_rows", f"""
    WITH p AS ({TEXT_PAIRS}), m AS (SELECT x AS k, ok FROM p UNION SELECT y, ok FROM p)
    SELECT k AS row_id, {verdict_sql('ok')} AS verdict, {key_sql('source')} AS block
    FROM m JOIN documents d ON d.doc_id = m.k""")
def _(t: Tables) -> DataFrame:
    return copies(t).participants().select("row_id", "verdict", key_text("role_key").alias("block"))


def compared_sql(table: str, row_id: str, on: str, head: str) -> str:
    """Pairs of an earlier row a and a later row b."""
    return f"SELECT a.{row_id} AS x, b.{row_id} AS y, {head} AS ok FROM {table} a JOIN {table} b ON {on} AND a.{row_id} < b.{row_id}"


def pairs_sql(rule_id: str, table: str, pairs: str) -> str:
    return metrics_sql(
        rule_id, "pair",
        f"""SELECT (SELECT count(*) FROM {table}) AS total_rows, (SELECT count(DISTINCT k) FROM m) AS applicable_rows,
          (SELECT count(DISTINCT k) FROM m WHERE ok) AS sat_rows, (SELECT count(DISTINCT k) FROM m WHERE NOT ok) AS viol_rows,
          (SELECT count(*) FROM p WHERE ok) AS sat_groups, (SELECT count(*) FROM p WHERE NOT ok) AS viol_groups""",
        f"p AS ({pairs}), m AS (SELECT DISTINCT x AS k, ok FROM p UNION SELECT DISTINCT y, ok FROM p)")


def pair_rows_sql(pairs: str) -> str:
    return f"""WITH p AS ({pairs})
    SELECT DISTINCT x AS row_id, 'earlier' AS role, {verdict_sql('ok')} AS verdict FROM p
    UNION ALL SELECT DISTINCT y, 'later', {verdict_sql('ok')} FROM p"""


#: Rules on pairs of rows: rule id, table, row id, columns that match, condition, and the condition in SQL.
COMPARED = [
    ("pair_rule_ordered", "part", "p_partkey", ["p_brand"], pairs.Compare("p_size", "<="), "a.p_size <= b.p_size"),
    ("pair_rule_columns", "customer", "c_custkey", ["c_mktsegment", "c_nationkey"], pairs.Compare("c_acctbal", ">", "c_nationkey"),
     "a.c_acctbal > b.c_nationkey"),
    ("pair_rule_different", "customer", "c_custkey", ["c_mktsegment"], pairs.Compare("c_nationkey", "!="), "a.c_nationkey <> b.c_nationkey"),
    ("pair_rule_within", "part", "p_partkey", ["p_brand"], pairs.Compare("p_retailprice", "within", tol=100),
     "a.p_retailprice >= b.p_retailprice - 100 AND a.p_retailprice <= b.p_retailprice + 100"),
]
for rule_id, table, row_id, match, head, test in COMPARED:
    pairs_of = compared_sql(table, row_id, " AND ".join(f"a.{c} = b.{c}" for c in match), test)

    def compared(t: Tables, rule_id=rule_id, table=table, row_id=row_id, match=match, head=head) -> RuleResult:
        return pairs.pair_rule(getattr(t, table), match, head=head, row_id=row_id, rule_id=rule_id)

    query(rule_id, pairs_sql(rule_id, table, pairs_of))(lambda t, rule=compared: metrics_out(rule(t)))
    query(f"{rule_id}_rows", pair_rows_sql(pairs_of))(lambda t, rule=compared: rule(t).participants().select("row_id", "role", "verdict"))


# ---- two tables ------------------------------------------------------------------------------------------

REFERENCE = "user_id IN (SELECT s_suppkey FROM supplier)"


def supplier_refs(t: Tables) -> RuleResult:
    return tables.references(t.events, "user_id", t.supplier, "s_suppkey", row_id="event_id", rule_id="references")


@query("references", row_sql("references", "events", REFERENCE))
def _(t: Tables) -> DataFrame:
    return metrics_out(supplier_refs(t))


@query("references_rows", f"SELECT event_id AS row_id, {verdict_sql(REFERENCE)} AS verdict FROM events")
def _(t: Tables) -> DataFrame:
    return supplier_refs(t).participants().select("row_id", "verdict")


@query("references_typed", row_sql("references_typed", "events", REFERENCE))
def _(t: Tables) -> DataFrame:
    primary = t.events.withColumn("user_id", F.col("user_id").cast("double"))
    secondary = t.supplier.withColumn("s_suppkey", F.col("s_suppkey").cast("string"))
    return metrics_out(tables.references(primary, "user_id", secondary, "s_suppkey", row_id="event_id", rule_id="references_typed"))


def shipped_after_order(t: Tables) -> RuleResult:
    return tables.cross_table_rule(
        t.lineitem, t.orders, [("l_orderkey", "o_orderkey")], "l_shipdate >= o_orderdate", row_id=LINE_ID,
        cols="l_shipdate", secondary_cols="o_orderdate", rule_id="cross_table")


@query("cross_table", metrics_sql(
    "cross_table", "row",
    """SELECT (SELECT count(*) FROM lineitem) AS total_rows, count(*) AS applicable_rows,
      count(*) FILTER (WHERE l_shipdate >= o_orderdate) AS sat_rows,
      count(*) FILTER (WHERE l_shipdate < o_orderdate) AS viol_rows, 0 AS sat_groups, 0 AS viol_groups
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(shipped_after_order(t))


@query("cross_table_rows", f"""
    SELECT {LINE_COLUMNS}, {verdict_sql('l_shipdate >= o_orderdate')} AS verdict
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t: Tables) -> DataFrame:
    return line_rows(shipped_after_order(t).participants())


@query("cross_table_sum", metrics_sql(
    "cross_table_sum", "row",
    """SELECT (SELECT count(*) FROM orders) AS total_rows, count(*) AS applicable_rows,
      count(*) FILTER (WHERE s <= o_totalprice::DECIMAL(28,6)) AS sat_rows,
      count(*) FILTER (WHERE s > o_totalprice::DECIMAL(28,6)) AS viol_rows, 0 AS sat_groups, 0 AS viol_groups
      FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(28,6)) AS s FROM lineitem GROUP BY 1)
        ON l_orderkey = o_orderkey"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(tables.cross_table_rule(
        t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], f"line_total <= cast(o_totalprice as {MONEY})",
        row_id="o_orderkey", cols="o_totalprice", secondary_cols="l_extendedprice",
        aggs={"line_total": F.sum(F.col("l_extendedprice").cast(MONEY))}, rule_id="cross_table_sum"))


@query("cross_table_all_later", metrics_sql(
    "cross_table_all_later", "row",
    """SELECT (SELECT count(*) FROM orders) AS total_rows, count(*) AS applicable_rows,
      count(*) FILTER (WHERE lo >= o_orderdate) AS sat_rows, count(*) FILTER (WHERE lo < o_orderdate) AS viol_rows,
      0 AS sat_groups, 0 AS viol_groups
      FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS lo FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""))
def _(t: Tables) -> DataFrame:
    return metrics_out(tables.cross_table_rule(
        t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], "first_shipment >= o_orderdate", row_id="o_orderkey",
        cols="o_orderdate", secondary_cols="l_shipdate", aggs={"first_shipment": F.min("l_shipdate")},
        rule_id="cross_table_all_later"))


def big_orders(t: Tables, quantifier: str) -> RuleResult:
    test = "o_totalprice > 450000" if quantifier == "any" else "o_totalprice <= 450000"
    return tables.quantified_rule(
        t.customer, t.orders, [("c_custkey", "o_custkey")], test, quantifier, row_id="c_custkey",
        secondary_cols="o_totalprice", rule_id=f"cross_{quantifier}")


BIG = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"


@query("cross_any", row_sql("cross_any", "customer", BIG))
def _(t: Tables) -> DataFrame:
    return metrics_out(big_orders(t, "any"))


@query("cross_all", row_sql("cross_all", "customer", f"NOT {BIG}"))
def _(t: Tables) -> DataFrame:
    return metrics_out(big_orders(t, "all"))


@query("cross_any_rows", f"SELECT c_custkey AS row_id, {verdict_sql(BIG)} AS verdict FROM customer")
def _(t: Tables) -> DataFrame:
    return big_orders(t, "any").participants().select("row_id", "verdict")


#: Conditions on a row of each table: rule id, quantifier, predicate, further arguments, and the condition in SQL.
MIXED = [
    ("cross_any_later", "any", "o_orderdate < l_shipdate AND l_quantity > 45", {"primary_cols": "o_orderdate", "secondary_cols": ["l_shipdate", "l_quantity"]},
     "o_orderdate < l_shipdate AND l_quantity > 45"),
    ("cross_all_later", "all", "o_orderdate < l_shipdate OR l_returnflag = 'R'", {"primary_cols": "o_orderdate", "secondary_cols": ["l_shipdate", "l_returnflag"]},
     "o_orderdate < l_shipdate OR l_returnflag = 'R'"),
    ("cross_any_compare", "any", pairs.Compare("o_orderdate", ">", "l_shipdate"), {}, "o_orderdate > l_shipdate"),
    ("cross_all_compare", "all", pairs.Compare("o_totalprice", ">=", "l_extendedprice"), {}, "o_totalprice >= l_extendedprice"),
    ("cross_any_within", "any", pairs.Compare("o_totalprice", "within", "l_extendedprice", 20_000), {},
     "o_totalprice >= l_extendedprice - 20000 AND o_totalprice <= l_extendedprice + 20000"),
]
for rule_id, quantifier, predicate, more, test in MIXED:
    held = f"EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND ({test}))" if quantifier == "any" else (
        f"NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT ({test}))")

    def mixed(t: Tables, rule_id=rule_id, quantifier=quantifier, predicate=predicate, more=more) -> RuleResult:
        return tables.quantified_rule(t.orders, t.lineitem, [("o_orderkey", "l_orderkey")], predicate, quantifier, row_id="o_orderkey", rule_id=rule_id, **more)

    query(rule_id, row_sql(rule_id, "orders", held))(lambda t, rule=mixed: metrics_out(rule(t)))
    query(f"{rule_id}_rows", f"SELECT o_orderkey AS row_id, {verdict_sql(held)} AS verdict FROM orders")(
        lambda t, rule=mixed: rule(t).participants().select("row_id", "verdict"))


def bad_orders(t: Tables) -> tuple[RuleResult, DataFrame]:
    """Orders with three appended records, two of them with a customer that does not exist, checked against the customers."""
    steps = [
        {"table_to_modify": "orders", "record_to_add": {"_id": -1, "o_orderkey": -1, "o_custkey": -7, "o_totalprice": 1.0}},
        {"table_to_modify": "orders", "record_to_add": {"_id": -2, "o_orderkey": -2, "o_custkey": -8}},
        {"table_to_modify": "orders", "record_to_add": {"_id": -4, "o_orderkey": -4, "o_custkey": 1}},
        {"table_to_modify": "nowhere", "record_to_add": {"_id": -3, "o_orderkey": -3}},
    ]
    changed, ids = tables.inject(t.spark, {"orders": t.orders, "customer": t.customer}, steps)
    result = tables.references(
        changed["orders"], "o_custkey", changed["customer"], "c_custkey", row_id="o_orderkey", rule_id="injection")
    return result, t.spark.createDataFrame([(i,) for i in ids], "row_id bigint")


ADDED = "(VALUES (-1, -7), (-2, -8), (-4, 1)) i(o_orderkey, o_custkey)"
INJECTED = f"(SELECT o_custkey FROM orders UNION ALL SELECT o_custkey FROM {ADDED}) x"


@query("injection", row_sql("injection", INJECTED, "o_custkey IN (SELECT c_custkey FROM customer)"))
def _(t: Tables) -> DataFrame:
    return metrics_out(bad_orders(t)[0])


@query("injected_found", f"""
    WITH v AS (SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM {ADDED})
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    SELECT count(*) AS injected, count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM v)) AS found,
      bool_or(o_orderkey IN (SELECT o_orderkey FROM v)) AS any_found, (SELECT max(o_orderkey) FROM orders) AS last_order FROM {ADDED}""")
def _(t: Tables) -> DataFrame:
    result, ids = bad_orders(t)
    found = tables.injected_found(result.violations(), ids)
    return found.withColumn("last_order", t.orders.agg(F.max("o_orderkey")).scalar())


@query("violation_rate_check", """
    WITH r AS (SELECT 'row_conditional' AS rule_id,
        count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE / count(*) AS rate, 0.5 AS expected
      FROM lineitem WHERE l_quantity > 40
      UNION ALL SELECT 'references', count(*) FILTER (WHERE user_id NOT IN (SELECT s_suppkey FROM supplier))::DOUBLE / count(*), 0.0
      FROM events)
    SELECT rule_id, round(rate, 9) AS violation_rate, expected::DOUBLE AS expected_rate,
      abs(rate - expected) < 1e-6 AS rate_matches FROM r""")
def _(t: Tables) -> DataFrame:
    metrics = conditional(t).metrics.unionByName(supplier_refs(t).metrics)
    expected = t.spark.createDataFrame([("row_conditional", 0.5), ("references", 0.0)], "rule_id string, expected_rate double")
    checked = tables.violation_rate_check(metrics, expected)
    return checked.withColumn("violation_rate", F.round("violation_rate", 9))


# ---- user functions and catalogues -----------------------------------------------------------------------


def size_matches_brand(df: DataFrame) -> DataFrame:
    """A user rule: parts of one name must not come in more than 48 sizes."""
    sizes = df.groupBy("p_name").agg(F.count_distinct("p_size").alias("sizes"))
    verdict = F.when(F.col("sizes") <= 48, F.lit(SATISFACTION)).otherwise(F.lit(VIOLATION))
    key = F.array(F.struct(F.lit("p_name").alias("col"), F.col("p_name").alias("val")))
    return df.join(sizes, "p_name").select(verdict.alias("verdict"), F.col("p_partkey").alias("row_id"), key.alias("group_key"))


@query("custom_rule", group_sql(
    "custom_rule", "SELECT count(*) AS n, count(DISTINCT p_size) <= 48 AS ok FROM part GROUP BY p_name", "part"))
def _(t: Tables) -> DataFrame:
    return metrics_out(custom.custom_rule(size_matches_brand, t.part, rule_id="custom_rule"))


def order_count_rule(t: Tables) -> RuleResult:
    return custom.pandas_group_rule(
        t.orders, "o_custkey", ["o_totalprice"],
        summarise=lambda part: {"n": len(part), "top": part["o_totalprice"].max()},
        combine=lambda states: {"n": states["n"].sum(), "top": states["top"].max()},
        judge=lambda s: 5 <= s["n"] <= 12 and s["top"] > 250000,
        state="n long, top double", row_id="o_orderkey", rule_id="pandas_group_rule")


PANDAS_GROUPS = "SELECT o_custkey, count(*) AS n, count(*) BETWEEN 5 AND 12 AND max(o_totalprice) > 250000 AS ok FROM orders GROUP BY o_custkey"


@query("pandas_group_rule", group_sql("pandas_group_rule", PANDAS_GROUPS, "orders"))
def _(t: Tables) -> DataFrame:
    return metrics_out(order_count_rule(t))


@query("pandas_group_rule_rows", f"""
    SELECT o_orderkey AS row_id, {verdict_sql('ok')} AS verdict FROM orders JOIN ({PANDAS_GROUPS}) USING (o_custkey)""")
def _(t: Tables) -> DataFrame:
    return order_count_rule(t).participants().select("row_id", "verdict")


CATALOGUE = [
    RuleSpec("balance", "customer", "row", "c_custkey", {"head": "c_acctbal >= 0", "cols": ["c_acctbal"]}),
    RuleSpec("segment", "customer", "pattern", "c_custkey", {"col": "c_mktsegment", "pattern": "^[A-Z]+$"}),
    RuleSpec("segment_known", "customer", "not_null", "c_custkey", {"cols": ["c_mktsegment"]}),
    RuleSpec("name_key", "customer", "unique_key", "c_custkey", {"key": ["c_name"]}),
    RuleSpec("name_balance", "customer", "aggregate_constraint", "c_custkey", {
        "key": ["c_name"], "agg": "min", "predicate": "agg_value >= 0", "value": "c_acctbal"}),
    RuleSpec("nation_segment", "customer", "functional_dependency", "c_custkey", {"lhs": ["c_nationkey"], "rhs": ["c_mktsegment"]}),
    RuleSpec("nation_exists", "customer", "references", "c_custkey", {"fk": "c_nationkey", "pk": "n_nationkey"}, "nation"),
]


@query("rule_catalogue", " UNION ALL ".join(f"({s})" for s in [
    row_sql("balance", "customer", "c_acctbal >= 0"),
    row_sql("segment", "customer", "regexp_matches(c_mktsegment, '^[A-Z]+$')"),
    row_sql("segment_known", "customer", "c_mktsegment IS NOT NULL"),
    group_sql("name_key", "SELECT count(*) AS n, count(*) = 1 AS ok FROM customer GROUP BY c_name", "customer"),
    group_sql("name_balance", "SELECT count(*) AS n, min(c_acctbal) >= 0 AS ok FROM customer GROUP BY c_name", "customer"),
    fd_sql("nation_segment", "customer", "c_nationkey", "c_mktsegment"),
    row_sql("nation_exists", "customer", "c_nationkey IN (SELECT n_nationkey FROM nation)"),
]))
def _(t: Tables) -> DataFrame:
    return metrics_out(metrics_plan(CATALOGUE, {"customer": t.customer, "nation": t.nation}))


