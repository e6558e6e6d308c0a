"""Registered queries around the rules: results, reports, profiles, test data, text, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions import text
from rulespan.functions.prep import coerce, normalized_pair
from rulespan.model import VIOLATION, RuleResult
from rulespan.operators import chunks, groups, metrics, profile, ranking, report, retrieval, rows, sketches, synth
from rulespan.plans.chunk_sql import chunks_sql
from rulespan.plans.registry import Tables, group_sql, key_text, metrics_out, metrics_sql, query, verdict_sql
from rulespan.plans.rule_queries import FD_ROWS, LABELLED, LINE_ID, copies, event_order, labelled, part_fd
from rulespan.session import shared_folder
from rulespan.sources.corpus import snippet_text

# ---- results ---------------------------------------------------------------------------------------------


@query("metrics_from_participants", group_sql(
    "fd", "SELECT count(*) AS n, count(DISTINCT p_type) = 1 AS ok FROM part GROUP BY p_name, p_brand", "part"))
def _(t: Tables) -> DataFrame:
    return metrics_out(metrics.metrics_of(part_fd(t).participants(), t.part, "fd"))


@query("metrics_from_pairs", """
    WITH p AS (SELECT event_id, lag(event_id) OVER w AS prev, event_type <> lag(event_type) OVER w AS ok
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT count(*) FILTER (WHERE ok) AS sat_pairs, count(*) FILTER (WHERE NOT ok) AS viol_pairs FROM p""")
def _(t: Tables) -> DataFrame:
    made = metrics.metrics_of(event_order(t).participants(), t.events, "sequence_rule", "pair")
    return made.select(*[F.col(f"{side}_groups").cast("bigint").alias(f"{side}_pairs") for side in ("sat", "viol")])


@query("nested", f"""
    WITH f AS ({FD_ROWS}),
      r AS (SELECT verdict, group_key, role_key, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS ids FROM f GROUP BY ALL)
    SELECT verdict, group_key, string_agg(role_key || ':' || ids, ';' ORDER BY role_key) AS representation
    FROM r GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    nested = metrics.nest(part_fd(t).participants(), upper=t.part.count())
    entry = F.transform(
        "representations",
        lambda r: F.concat(key_text(r["role_key"]), F.lit(":"), F.array_join(r["rows"].cast("array<string>"), ",")),
    )
    return nested.select("verdict", key_text().alias("group_key"), F.array_join(entry, ";").alias("representation"))


@query("participants", f"SELECT verdict, row_id FROM ({FD_ROWS})")
def _(t: Tables) -> DataFrame:
    return metrics.participant_ids(metrics.nest(part_fd(t).participants(), upper=t.part.count())).select("verdict", "row_id")


def wide_fd(t: Tables):
    return groups.functional_dependency(t.part, ["p_name", "p_brand", "p_size"], "p_type", row_id="p_partkey", rule_id="fd")


@query("compare_results", """
    WITH a AS (SELECT p_partkey, (count(*) OVER w = 1) OR (min(p_type) OVER w = max(p_type) OVER w) AS ok
        FROM part WINDOW w AS (PARTITION BY p_name, p_brand)),
      e AS (SELECT p_partkey, min(p_type) OVER w = max(p_type) OVER w AS ok
        FROM part WINDOW w AS (PARTITION BY p_name, p_brand, p_size))
    SELECT 'fd' AS rule_id, count(*) FILTER (WHERE a.ok = e.ok) AS common_rows,
      count(*) FILTER (WHERE NOT e.ok AND a.ok) AS missing_violations,
      count(*) FILTER (WHERE NOT a.ok AND e.ok) AS unexpected_violations,
      count(*) FILTER (WHERE e.ok AND NOT a.ok) AS missing_satisfactions,
      count(*) FILTER (WHERE a.ok AND NOT e.ok) AS unexpected_satisfactions,
      count(*) FILTER (WHERE a.ok <> e.ok) = 0 AS success
    FROM a JOIN e USING (p_partkey)""")
def _(t: Tables) -> DataFrame:
    return report.compare_results(part_fd(t).participants(), wide_fd(t).participants())


@query("compare_metrics", """
    WITH a AS (SELECT count(*) FILTER (WHERE k = 1)::DOUBLE / count(*) AS c, sum(n)::DOUBLE / (SELECT count(*) FROM part) AS s FROM
        (SELECT count(DISTINCT p_type) AS k, count(*) AS n FROM part GROUP BY p_name, p_brand)),
      e AS (SELECT count(*) FILTER (WHERE k = 1)::DOUBLE / count(*) AS c, sum(n)::DOUBLE / (SELECT count(*) FROM part) AS s FROM
        (SELECT count(DISTINCT p_type) AS k, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_name, p_brand, p_size))
    SELECT 'fd' AS rule_id, round(a.c, 9) AS confidence, round(e.c, 9) AS expected_confidence, round(a.s, 9) AS support, round(e.s, 9) AS expected_support,
      abs(a.s - e.s) <= 0.01 AS support_matches, abs(a.c - e.c) <= 0.01 AS confidence_matches FROM a, e""")
def _(t: Tables) -> DataFrame:
    some = groups.functional_dependency(t.part, ["p_name", "p_brand", "p_size"], "p_type", body="p_size > 10", row_id="p_partkey", rule_id="fd")
    compared = report.compare_metrics(part_fd(t).metrics, some.metrics)
    rounded = [F.round(c, 9).alias(c) for c in ("confidence", "expected_confidence", "support", "expected_support")]
    return compared.select("rule_id", *rounded, "support_matches", "confidence_matches")


@query("pass_rate", """
    SELECT o_orderpriority, count(*) AS total_cases, count(*) FILTER (WHERE ok) AS passed_cases,
      round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 9) AS pass_rate,
      count(*) FILTER (WHERE ok)::DOUBLE / count(*) >= 0.5 AS passed
    FROM (SELECT o_orderpriority, o_totalprice <= 250000 AS ok FROM orders) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    cases = t.orders.select("o_orderpriority", (F.col("o_totalprice") <= 250000).alias("success"))
    return report.pass_rate(cases, ["o_orderpriority"]).withColumn("pass_rate", F.round("pass_rate", 9))


# Events read as a run log: the value is the run time, errors are failed runs; some rules lack a table, their text or a result.
LIMIT_SECONDS = 300.0
RUN_LOG = f"""(SELECT event_id, user_id, value AS seconds, event_type IN ('signup', 'purchase') AS injected, value > 50 AS injected_found,
    CASE WHEN user_id % 13 = 0 THEN 'skipped_missing_info'
         WHEN event_id % 17 = 0 THEN 'skipped_dataframe_load_failed'
         WHEN value > {LIMIT_SECONDS} THEN 'processed_execution_timeout'
         WHEN event_type = 'error' THEN 'processed_execution_error'
         WHEN event_id % 11 = 0 THEN 'processed_bad_output_format'
         ELSE 'processed_execution_successful' END AS status FROM events)"""


def run_log(t: Tables) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.lit("error"))
    told, loaded, output = F.col("user_id") % 13 != 0, F.col("event_id") % 17 != 0, F.col("event_id") % 11 != 0
    status = report.run_status(told, loaded, F.col("value"), error, output, LIMIT_SECONDS)
    return t.events.select(
        "event_id",
        "user_id",
        F.col("value").alias("seconds"),
        F.col("event_type").isin("signup", "purchase").alias("injected"),
        (F.col("value") > 50).alias("injected_found"),
        status.alias("status"),
    )


@query("run_status", f"SELECT event_id, status FROM {RUN_LOG}")
def _(t: Tables) -> DataFrame:
    return run_log(t).select("event_id", "status")


@query("run_summary", f"""
    SELECT count(*) AS total_rules, round(avg(seconds), 6) AS average_seconds, count(seconds) AS timed_rules,
      count(*) FILTER (WHERE injected) AS injected_rules, count(*) FILTER (WHERE injected AND injected_found) AS injected_found_rules,
      count(*) FILTER (WHERE status LIKE '%successful') AS ok_rules, count(*) FILTER (WHERE status LIKE '%timeout') AS timeout_rules,
      count(*) FILTER (WHERE status LIKE '%error' OR status LIKE '%format') AS failed_rules, count(*) FILTER (WHERE status LIKE 'skipped%') AS skipped_rules,
      round(100.0 * count(*) FILTER (WHERE injected AND injected_found) / count(*) FILTER (WHERE injected), 6)::DOUBLE AS injected_found_percent
    FROM {RUN_LOG}""")
def _(t: Tables) -> DataFrame:
    summary = report.run_summary(run_log(t))
    rounded = {c: F.round(F.col(c).cast("double"), 6) for c in ("average_seconds", "injected_found_percent")}
    return summary.withColumns(rounded)


@query("first_seen", "SELECT props, min(event_id) AS first_seen FROM events GROUP BY props")
def _(t: Tables) -> DataFrame:
    return report.first_seen(t.events, "props", "event_id")


@query("fastest_variant", f"""
    SELECT user_id, arg_min(event_id, (seconds, event_id)) AS variant, min(seconds) AS seconds FROM {RUN_LOG}
    WHERE status = 'processed_execution_successful' GROUP BY user_id""")
def _(t: Tables) -> DataFrame:
    return report.fastest_variant(run_log(t), "event_id", by=["user_id"])


PART_KEYS = """SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_name, p_brand) = 1 AS ok,
    '[{"col":"p_name","val":"' || p_name || '"},{"col":"p_brand","val":"' || p_brand || '"}]' AS group_key FROM part"""


DRILL_DOWN = f"""
    WITH k AS ({PART_KEYS}),
      g AS (SELECT ok, group_key, count(*) AS n, row_number() OVER (PARTITION BY ok ORDER BY group_key) AS group_no,
        count(*) OVER (PARTITION BY ok) AS all_groups FROM k GROUP BY ok, group_key),
      r AS (SELECT k.*, g.n, g.group_no, g.all_groups, row_number() OVER (PARTITION BY k.ok, k.group_key ORDER BY p_partkey) AS row_no
        FROM k JOIN g ON g.ok = k.ok AND g.group_key = k.group_key)
    SELECT {verdict_sql('ok')} AS verdict, group_key, group_no::BIGINT AS group_no, greatest(all_groups - 10, 0)::BIGINT AS more_groups,
      CASE WHEN ok THEN 'unique_record' ELSE 'duplicates' END AS role, row_no::BIGINT AS row_no,
      greatest(n - 5, 0)::BIGINT AS more_rows, p_partkey AS row_id, p_type
    FROM r WHERE group_no <= 10 AND row_no <= 5"""


def part_key(df: DataFrame) -> RuleResult:
    return groups.unique_key(df, ["p_name", "p_brand"], row_id="p_partkey")


def drilled(shown: DataFrame) -> DataFrame:
    longs = [F.col(c).cast("bigint").alias(c) for c in ("group_no", "more_groups", "row_no", "more_rows")]
    return shown.select("verdict", "group_key", "role", "row_id", "p_type", *longs)


@query("drill_down", DRILL_DOWN)
def _(t: Tables) -> DataFrame:
    return drilled(report.drill_down(part_key, t.part, ["p_name", "p_brand"], "p_partkey"))


@query("drill_down_stored", DRILL_DOWN)
def _(t: Tables) -> DataFrame:
    return drilled(report.drill_down_stored(part_key(t.part).participants(), t.part, "p_partkey"))


@query("drill_down_rows", f"""
    WITH r AS (SELECT c_custkey, c_name, c_acctbal >= 0 AS ok FROM customer),
      n AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY c_custkey) AS row_no, count(*) OVER (PARTITION BY ok) AS c FROM r)
    SELECT {verdict_sql('ok')} AS verdict, c_custkey AS row_id, c_name, row_no::BIGINT AS row_no, greatest(c - 20, 0)::BIGINT AS more_rows
    FROM n WHERE row_no <= 20""")
def _(t: Tables) -> DataFrame:
    found = rows.row_rule(t.customer, "c_acctbal >= 0", row_id="c_custkey").participants()
    shown = report.drill_down_rows(found, t.customer, "c_custkey")
    return shown.select("verdict", "row_id", "c_name", *[F.col(c).cast("bigint").alias(c) for c in ("row_no", "more_rows")])


@query("overview", """
    WITH g AS (SELECT count(*) AS n, count(*) = 1 AS ok FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT 'unique_key' AS rule_id, 'group' AS rule_class, sum(n)::BIGINT AS table_rows, 11 AS table_columns,
      sum(n) FILTER (WHERE NOT ok)::BIGINT AS violating_rows, sum(n) FILTER (WHERE ok)::BIGINT AS satisfying_rows,
      count(*) FILTER (WHERE NOT ok) AS violating_groups, count(*) FILTER (WHERE ok) AS satisfying_groups,
      1.0::DOUBLE AS support, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 9) AS confidence FROM g""")
def _(t: Tables) -> DataFrame:
    result = groups.unique_key(t.lineitem, ["l_orderkey", "l_linenumber"], row_id=LINE_ID, rule_id="unique_key")
    shown = report.overview(result.metrics, t.lineitem)
    whole = {c: F.col(c).cast("bigint") for c in ("violating_groups", "satisfying_groups")}
    return shown.withColumns({**whole, "confidence": F.round("confidence", 9)})


# ---- preparation, samples and profiles -------------------------------------------------------------------


@query("coerce", """
    SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, try_cast(event_type AS DOUBLE) AS kind FROM events""")
def _(t: Tables) -> DataFrame:
    raw = t.events.select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"), F.col("event_type").alias("kind"))
    return coerce(raw, {"k": "bigint", "kind": "double"})


@query("normalize_id", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS as_id, user_id AS other_id FROM events""")
def _(t: Tables) -> DataFrame:
    # Every third id is made fractional, which is no id.
    mixed = t.events.withColumn(
        "loose", F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.lit(".5")).otherwise(F.lit(".0")))
    )
    left, right = normalized_pair(mixed, "loose", mixed, "user_id")
    return mixed.select("event_id", left.alias("as_id"), right.alias("other_id"))


@query("sample_rows", "SELECT p_partkey, p_name, p_size FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 100")
def _(t: Tables) -> DataFrame:
    return profile.sample_rows(t.part, 100, "p_partkey").select("p_partkey", "p_name", "p_size")


@query("head_sample", "SELECT * FROM part ORDER BY p_partkey LIMIT 3")
def _(t: Tables) -> DataFrame:
    return profile.head_sample(t.part, "p_partkey")


@query("head_samples", """
    (SELECT 'region' AS table_name, to_json({r_regionkey: r_regionkey, r_name: r_name})::VARCHAR AS record
      FROM region ORDER BY r_regionkey LIMIT 3)
    UNION ALL (SELECT 'nation', to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey})::VARCHAR
      FROM nation ORDER BY n_nationkey LIMIT 3)""")
def _(t: Tables) -> DataFrame:
    return profile.head_samples({"region": t.region, "nation": t.nation}, {"region": "r_regionkey", "nation": "n_nationkey"})


@query("dataset_summary", """
    SELECT 'c_custkey: bigint, c_name: string, c_nationkey: int, c_acctbal: double, c_mktsegment: string' AS columns,
      to_json({c_custkey: c_custkey, c_name: c_name, c_nationkey: c_nationkey, c_acctbal: c_acctbal, c_mktsegment: c_mktsegment})::VARCHAR AS record
    FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 5""")
def _(t: Tables) -> DataFrame:
    return profile.dataset_summary(t.customer, 5, "c_custkey")


def profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, "
        f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)::BIGINT AS distinct_values FROM {table}"
        for c, kind in columns.items())


LABELLED_TYPES = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query("column_profile", profile_sql(f"{LABELLED} x", LABELLED_TYPES))
def _(t: Tables) -> DataFrame:
    return profile.column_profile(labelled(t), one_pass=True)


@query("column_profile_lineitem", profile_sql("lineitem", {
    **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "bigint"), "l_linenumber": "int",
    **dict.fromkeys(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "double"),
    **dict.fromkeys(["l_returnflag", "l_linestatus"], "string"), "l_shipdate": "timestamp_ntz"}))
def _(t: Tables) -> DataFrame:
    return profile.column_profile(t.lineitem)


#: Columns of lineitem that are sketched, and which of them are numbers.
SKETCHED = {"l_orderkey": True, "l_partkey": True, "l_quantity": True, "l_extendedprice": True, "l_linestatus": False, "l_shipdate": False}


@query("column_profile_approx", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values,
      TRUE AS distinct_close, {'TRUE' if number else 'NULL::BOOLEAN'} AS quartiles_close, TRUE AS top_close FROM lineitem""" for c, number in SKETCHED.items()))
def _(t: Tables) -> DataFrame:
    """Sketches of the parts of a table, stored, merged and held against exact figures with the bounds they promise."""
    table = t.lineitem.select(*SKETCHED, "l_returnflag")
    folder = shared_folder(t.spark, "sketches")
    sketches.column_sketches(table, ["l_returnflag"]).write.parquet(folder)
    whole = sketches.merged_sketches(t.spark.read.parquet(folder))
    # A row per column of the table.
    found = {r.column_name: r for r in sketches.approximate_profile(whole, top=3).collect()}
    checks = []
    for c, number in SKETCHED.items():
        r, n = found[c], F.count(F.lit(1))
        exact = F.count_distinct(c)
        close = F.abs(exact - r.distinct_values) <= F.greatest(exact * sketches.DISTINCT_ERROR, F.lit(1))
        ranks = F.lit(None).cast("boolean")
        if number:
            error = sketches.RANK_ERROR
            inside = [(F.count_if(F.col(c) < r[q]) <= (p + error) * n) & (F.count_if(F.col(c) <= r[q]) >= (p - error) * n) for q, p in profile.QUARTILES.items()]
            ranks = inside[0] & inside[1] & inside[2]
        tops = F.lit(True)
        for x in r.top_values:
            tops = tops & (F.abs(F.count_if(F.col(c).cast("string") == x["value"]) - x["count"]) <= sketches.top_error() * n)
        checks.append(F.struct(
            F.lit(c).alias("column_name"), n.alias("rows"), F.lit(r.n).cast("long").alias("n"), F.lit(r.missing).cast("long").alias("missing"), exact.alias("distinct_values"),
            close.alias("distinct_close"), ranks.alias("quartiles_close"), tops.alias("top_close")))
    return table.agg(F.array(*checks).alias("c")).select(F.inline("c")).drop("rows")


@query("column_profile_merged", """
    SELECT l_linestatus, 'l_quantity' AS column_name, count(*) AS n, 0::BIGINT AS missing, count(DISTINCT l_quantity) AS distinct_values
    FROM lineitem GROUP BY l_linestatus""")
def _(t: Tables) -> DataFrame:
    """Few values: what sketches say of parts merged to larger parts is exact then."""
    fine = sketches.column_sketches(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"])
    merged = sketches.merged_sketches(fine, ["l_linestatus"])
    return sketches.approximate_profile(merged, ["l_linestatus"]).select("l_linestatus", "column_name", "n", "missing", "distinct_values")


def describe_sql(table: str, numeric: list[str], other: list[str]) -> str:
    def number(c: str) -> str:
        return f"""SELECT '{c}' AS column_name, count({c}) AS "count", NULL::BIGINT AS "unique", NULL::VARCHAR AS top,
          NULL::BIGINT AS freq, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
          quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50,
          quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max FROM {table}"""

    def word(c: str) -> str:
        counted = f"SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1"
        return f"""SELECT '{c}', sum(n)::BIGINT, count(*), arg_min(v, (-n, v))::VARCHAR, max(n),
          {", ".join(["NULL::DOUBLE"] * 7)} FROM ({counted})"""

    return " UNION ALL ".join([number(c) for c in numeric] + [word(c) for c in other])


def rounded_description(df: DataFrame, one_pass: bool = False) -> DataFrame:
    return profile.describe_all(df, one_pass).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("describe_all", describe_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def _(t: Tables) -> DataFrame:
    return rounded_description(t.part)


@query("describe_all_nulls", describe_sql(
    f"{LABELLED} x", ["doc_id", "n_chars", "quality", "toxic"], ["text", "lang", "source"]))
def _(t: Tables) -> DataFrame:
    return rounded_description(labelled(t), one_pass=True)


# ---- generated data --------------------------------------------------------------------------------------


@query("synthesize", """
    WITH u AS (SELECT o_orderkey AS row_id, o_orderkey // 5 AS unit, ((o_orderkey // 5) * 619 + 42) % 1000 < 200 AS planted FROM orders)
    SELECT *, 'v' || CASE WHEN planted AND row_id % 5 = 4 THEN unit + 1 ELSE unit END AS label FROM u""")
def _(t: Tables) -> DataFrame:
    return synth.synthesize_from(t.orders.select("o_orderkey"), "fd", 0.2)


@query("synthesize_checked", metrics_sql(
    "synthesize_checked", "group",
    """SELECT sum(n) AS total_rows, sum(n) AS applicable_rows, sum(n) FILTER (WHERE NOT planted) AS sat_rows,
      sum(n) FILTER (WHERE planted) AS viol_rows, count(*) FILTER (WHERE NOT planted) AS sat_groups,
      count(*) FILTER (WHERE planted) AS viol_groups FROM g""",
    """g AS (SELECT l_orderkey // 5 AS unit, count(*) AS n,
        ((l_orderkey // 5) * 619 + 42) % 1000 < 200 AND count(DISTINCT l_orderkey % 5 = 4) = 2 AS planted
      FROM lineitem GROUP BY l_orderkey // 5)"""))
def _(t: Tables) -> DataFrame:
    made = synth.synthesize_from(t.lineitem.select("l_orderkey"), "fd", 0.2)
    return metrics_out(groups.functional_dependency(made, "unit", "label", row_id="row_id", rule_id="synthesize_checked"))


# ---- text and retrieval ----------------------------------------------------------------------------------


@query("chunk_fixed", """
    WITH n AS (SELECT doc_id, text, unnest(range(ceil(greatest(length(text) - 200, 1) / 800.0)::BIGINT))::INTEGER AS chunk_no
      FROM documents WHERE length(text) > 0)
    SELECT doc_id, chunk_no, substring(text, chunk_no * 800 + 1, 1000) AS chunk FROM n""")
def _(t: Tables) -> DataFrame:
    return chunks.chunk_fixed(t.documents, "text").select("doc_id", "chunk_no", "chunk")


@query("chunk_separators", chunks_sql(chunks.CODE_PROFILE))
def _(t: Tables) -> DataFrame:
    return chunks.chunk_separators(t.documents.select("doc_id", "text"), "text").select("doc_id", "chunk_no", "chunk")


@query("chunk_separators_doc", chunks_sql(chunks.DOC_PROFILE))
def _(t: Tables) -> DataFrame:
    return chunks.chunk_separators(t.documents.select("doc_id", "text"), "text", "doc").select("doc_id", "chunk_no", "chunk")


def described_sources(t: Tables) -> DataFrame:
    """One row per source of the documents; type and description follow from the number in its name."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return t.documents.select("source").distinct().select(
        "source",
        F.when(number % 3 == 0, F.lit("web")).when(number % 3 == 1, F.lit("documentation")).otherwise(F.lit("code_snippet")).alias("source_type"),
        F.when(number % 2 == 0, F.lit("Reference Documentation")).otherwise(F.lit("Blog")).alias("description"),
        (number % 5 != 4).alias("enabled"),
    )


SOURCES = """(SELECT source, CASE k % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'documentation' ELSE 'code_snippet' END AS source_type,
    CASE k % 2 WHEN 0 THEN 'Reference Documentation' ELSE 'Blog' END AS description, k % 5 <> 4 AS enabled
  FROM (SELECT DISTINCT source, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS k FROM documents))"""
PROFILE_SQL = "(source_type = 'documentation' OR (source_type = 'web' AND contains(lower(description), 'documentation')))"


@query("source_counts", f"""
    SELECT source, source_type, profile, sum(ceil(greatest(length(text) - overlap, 1) / (size - overlap)::DOUBLE))::BIGINT AS chunks
    FROM (SELECT *, CASE WHEN {PROFILE_SQL} THEN 'doc' ELSE 'code' END AS profile,
        CASE WHEN {PROFILE_SQL} THEN 1500 ELSE 1000 END AS size, CASE WHEN {PROFILE_SQL} THEN 300 ELSE 200 END AS overlap
      FROM documents JOIN {SOURCES} USING (source) WHERE enabled AND length(text) > 0)
    GROUP BY source, source_type, profile""")
def _(t: Tables) -> DataFrame:
    tagged = chunks.tag_source(t.documents, chunks.enabled(described_sources(t)))
    profiled = tagged.withColumn("profile", chunks.profile_name(F.col("source_type"), F.col("description")))

    def setting(name: str) -> Column:
        return F.when(F.col("profile") == "doc", getattr(chunks.DOC_PROFILE, name)).otherwise(getattr(chunks.CODE_PROFILE, name))

    cut = chunks.chunk_fixed(profiled, "text", setting("size"), setting("overlap"))
    return chunks.source_counts(cut, ["source", "source_type", "profile"])


@query("page_text", r"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
      b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
        '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS x FROM a)
    SELECT page_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM b""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.page_text(F.col("html")).alias("text"))


def label_centroids(t: Tables) -> DataFrame:
    """The mean vector of every label, as queries."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg("x").alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("embedding"))


CENTROIDS = """q AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM (
    SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)
    GROUP BY label, i) GROUP BY label)"""


def top_k_sql(ctes: str, corpus: str, extra: str = "TRUE") -> str:
    return f"""WITH {ctes}, s AS (SELECT query_id, vec_id AS item_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score
        FROM q, {corpus} WHERE {extra}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s)
    SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def found(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query("top_k", top_k_sql(CENTROIDS, "embeddings"))
def _(t: Tables) -> DataFrame:
    return found(retrieval.top_k(label_centroids(t), t.embeddings, item_id="vec_id"))


@query("top_k_sources", top_k_sql(CENTROIDS, "(SELECT * FROM embeddings WHERE label IN (0, 1, 2))"))
def _(t: Tables) -> DataFrame:
    return found(retrieval.top_k(label_centroids(t), t.embeddings, item_id="vec_id", source="label", sources=[0, 1, 2]))


EACH = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("top_k_each", top_k_sql(EACH, "embeddings", "query_id <> vec_id"))
def _(t: Tables) -> DataFrame:
    return found(retrieval.top_k(t.embeddings, t.embeddings, query_id="vec_id", item_id="vec_id", skip_self=True))


@query("top_k_each_blocks", top_k_sql(EACH, "embeddings", "query_id <> vec_id"))
def _(t: Tables) -> DataFrame:
    return found(retrieval.top_k(
        t.embeddings, t.embeddings, query_id="vec_id", item_id="vec_id", skip_self=True, max_queries=150))


SCORED_URLS = r"""(SELECT page_id, url, host,
    (CASE WHEN starts_with(host, 'blog.') THEN 10 ELSE 0 END + CASE WHEN contains(host, 'doc') THEN 5 ELSE 0 END
     + CASE WHEN contains(path, '/en/') OR contains(path, '/fr/') THEN 3 ELSE 0 END
     + CASE WHEN contains(host, 'spam') OR contains(path, 'spam') THEN 5 ELSE 0 END)::INTEGER AS score
  FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages WHERE starts_with(url, 'http')))"""
SCORING = {"guide_words": ["/en/", "/fr/"], "topic": "spam"}


def blog_host() -> Column:
    return F.col("host").startswith("blog.")


@query("url_scores", f"SELECT page_id, host, score FROM {SCORED_URLS}")
def _(t: Tables) -> DataFrame:
    return retrieval.url_scores(t.pages, "url", trusted=blog_host(), **SCORING).select("page_id", "host", "score")


@query("rank_urls", f"SELECT page_id, url, score FROM {SCORED_URLS} ORDER BY score DESC, page_id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return retrieval.rank_urls(t.pages, "url", "page_id", 50, trusted=blog_host(), **SCORING).select("page_id", "url", "score")


@query("source_name", r"""
    SELECT page_id, translate(CASE WHEN path = '' THEN host ELSE host || '_' || regexp_extract(path, '([^/]*)$', 1) END, '.-', '__') AS source_name
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
      trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages)""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.source_name(F.col("url")).alias("source_name"))


def fenced_turns(t: Tables) -> DataFrame:
    """Conversation turns, those of the user put into a fence with words around it."""
    fence = F.concat(F.lit("see\n```python\n"), F.col("text"), F.lit("\n```\nand more"))
    return t.conversations.withColumn("text", F.when(F.col("role") == "user", fence).otherwise(F.col("text")))


@query("code_block", """
    WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'see' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'and more'
        ELSE text END AS x FROM conversations),
    s AS (SELECT *, string_split(x, '```') AS parts FROM f)
    SELECT conv_id, turn, CASE WHEN len(parts) >= 3 THEN trim(
        CASE WHEN starts_with(parts[2], 'python') THEN substr(parts[2], 7) ELSE parts[2] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      ELSE x END AS code FROM s""")
def _(t: Tables) -> DataFrame:
    return fenced_turns(t).select("conv_id", "turn", text.first_code_block(F.col("text")).alias("code"))


@query("json_payload", """
    WITH f AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'so:' || chr(10) || '```json' || chr(10) || props || chr(10) || '``` ok'
        WHEN 'view' THEN 'so: ' || props || ' ok' ELSE event_type END AS x FROM events)
    , s AS (SELECT *, string_split(x, '```') AS parts, strpos(x, '[') AS a1, length(x) - strpos(reverse(x), ']') + 1 AS a2,
        strpos(x, '{') AS b1, length(x) - strpos(reverse(x), '}') + 1 AS b2 FROM f),
    v AS (SELECT *, contains(x, '[') AND contains(x, ']') AND a2 > a1 AS a, contains(x, '{') AND contains(x, '}') AND b2 > b1 AS b FROM s)
    SELECT event_id, CASE WHEN len(parts) >= 3 THEN trim(
        CASE WHEN starts_with(parts[2], 'json') THEN substr(parts[2], 5) ELSE parts[2] END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))
      WHEN a AND (NOT b OR a1 < b1) THEN substr(x, a1, a2 - a1 + 1) WHEN b THEN substr(x, b1, b2 - b1 + 1)
      ELSE x END AS payload FROM v""")
def _(t: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    wrapped = (
        F.when(kind == "click", F.concat(F.lit("so:\n```json\n"), props, F.lit("\n``` ok")))
        .when(kind == "view", F.concat(F.lit("so: "), props, F.lit(" ok")))
        .otherwise(kind)
    )
    return t.events.select("event_id", text.json_payload(wrapped).alias("payload"))


@query("report_sections", """
    SELECT p_partkey, 'Look at ' || p_name AS analysis,
      CASE WHEN p_size % 4 = 0 THEN '' ELSE 'use ' || p_brand || '|check ' || p_type END AS recommendations,
      CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size > 25 THEN 'High' ELSE 'Low' END AS potential,
      CASE WHEN p_size > 40 THEN 'TERMINATE OPTIMIZATION' ELSE 'CONTINUE OPTIMIZATION' END AS decision,
      p_size <= 40 AS continues FROM part""")
def _(t: Tables) -> DataFrame:
    size = F.col("p_size")
    advice = F.concat(
        F.lit(f"{text.REPORT_RECOMMENDATIONS}:\n- use "), F.col("p_brand"), F.lit("\n-  check "), F.col("p_type"),
        F.lit(f"\n\n{text.REPORT_POTENTIAL}: "), F.when(size > 25, F.lit("High")).otherwise(F.lit("Low")), F.lit("\n"))
    review = F.concat(
        F.lit(f"{text.REPORT_ANALYSIS}:\nLook at "), F.col("p_name"),
        F.when(size % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("\n"), advice)))
    decided = F.concat(F.lit(f"{text.REPORT_DECISION}: "), F.when(size > 40, F.lit("TERMINATE OPTIMIZATION")).otherwise(F.lit(text.CONTINUE)), F.lit("\n"))
    parts = text.report_sections(F.concat(decided, review))
    return t.part.select(
        "p_partkey", parts["analysis"].alias("analysis"), F.array_join(parts["recommendations"], "|").alias("recommendations"),
        parts["potential"].alias("potential"), parts["decision"].alias("decision"), parts["continues"].alias("continues"))


# ---- usage ranking ---------------------------------------------------------------------------------------

AS_OF = "TIMESTAMP '2024-02-15 00:00:00'"
USAGE = "SELECT user_id, count(*) AS usage_count, avg((event_type <> 'error')::INTEGER::DOUBLE) AS success_rate, max(ts) AS last_used FROM events GROUP BY user_id"
SMOOTHED = """(WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS j,
      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, sum(CASE WHEN j = n - 1 THEN pow(0.7, j) ELSE 0.3 * pow(0.7, j) END * value) AS v FROM o GROUP BY user_id)"""
SCORES = f"""(SELECT u.*, s.v AS execution_time, m.biggest AS memory_usage,
      success_rate * 40 + 30 * (1 - (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()))
      + 20 * (1 - (biggest - min(biggest) OVER ()) / (max(biggest) OVER () - min(biggest) OVER ()))
      + greatest(0, 10 - least(10, floor((epoch({AS_OF}) - floor(epoch(last_used))) / 86400) / 30 * 10)) AS score
    FROM ({USAGE}) u JOIN {SMOOTHED} s USING (user_id) JOIN (SELECT user_id, max(value) AS biggest FROM events GROUP BY 1) m USING (user_id))"""


def user_stats(t: Tables) -> DataFrame:
    return ranking.usage_stats(t.events, "user_id", "ts", F.col("event_type") != "error")


def user_ema(t: Tables) -> DataFrame:
    return ranking.ema(t.events, "user_id", ["ts", "event_id"], "value", name="execution_time")


def user_scores(t: Tables) -> DataFrame:
    memory = t.events.groupBy("user_id").agg(F.max("value").alias("memory_usage"))
    stats = user_stats(t).join(user_ema(t), "user_id").join(memory, "user_id")
    return ranking.quality_score(stats, F.expr(AS_OF))


@query("usage_stats", f"SELECT user_id, usage_count, round(success_rate, 9) AS success_rate, last_used FROM ({USAGE})")
def _(t: Tables) -> DataFrame:
    return user_stats(t).withColumn("success_rate", F.round("success_rate", 9))


@query("ema", f"SELECT user_id, round(v, 6) AS execution_time FROM {SMOOTHED}")
def _(t: Tables) -> DataFrame:
    return user_ema(t).withColumn("execution_time", F.round("execution_time", 6))


@query("quality_score", f"SELECT user_id, round(score, 6) AS quality_score FROM {SCORES}")
def _(t: Tables) -> DataFrame:
    return user_scores(t).select("user_id", F.round("quality_score", 6).alias("quality_score"))


TAGS = "CASE user_id % 3 WHEN 0 THEN 'join, sort' WHEN 1 THEN 'group_by' END"


def tagged_scores(t: Tables) -> DataFrame:
    rest = F.col("user_id") % 3
    tags = F.when(rest == 0, F.lit("join, sort")).when(rest == 1, F.lit("group_by"))
    return user_scores(t).select("user_id", tags.alias("tags"), F.round("quality_score", 6).alias("quality_score"))


@query("top_snippets", f"""
    SELECT user_id, {TAGS} AS tags, round(score, 6) AS quality_score FROM {SCORES} ORDER BY 3 DESC, user_id LIMIT 10""")
def _(t: Tables) -> DataFrame:
    return ranking.top_snippets(tagged_scores(t), "user_id")


@query("top_snippets_tagged", f"""
    SELECT user_id, {TAGS} AS tags, round(score, 6) AS quality_score FROM {SCORES}
    WHERE coalesce(regexp_matches({TAGS}, 'so.t|gro'), FALSE) ORDER BY 3 DESC, user_id LIMIT 10""")
def _(t: Tables) -> DataFrame:
    return ranking.top_snippets(tagged_scores(t), "user_id", tag="so.t|gro")


@query("register_new", """
    SELECT 'doc' || doc_id AS snippet_id, source || '/' || doc_id AS filepath,
      CASE WHEN doc_id % 2 = 0 THEN coalesce(trim(replace(list_last(list_filter(string_split(text, chr(10))[1:1],
        lambda l: starts_with(l, '# ') AND NOT contains(l, 'Tags:') AND NOT contains(l, 'Metrics:'))), '#', '')), source || ' ' || lang)
        ELSE coalesce(trim(replace(list_last(list_filter(string_split(text, chr(10))[1:5],
        lambda l: starts_with(l, '# ') AND NOT contains(l, 'Tags:') AND NOT contains(l, 'Metrics:'))), '#', '')), 'Generated code snippet') END AS description,
      CASE WHEN doc_id % 2 = 0 THEN lang || ', ' || source ELSE '' END AS tags,
      NULL::DOUBLE AS execution_time, NULL::DOUBLE AS memory_usage, epoch(TIMESTAMP '2024-02-15 00:00:00')::BIGINT AS last_used,
      0::BIGINT AS usage_count, 0.0::DOUBLE AS success_rate, 50.0::DOUBLE AS quality_score
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t: Tables) -> DataFrame:
    # Every second document is stored with a header, the others are bare.
    headed = snippet_text(
        F.col("text"), F.concat_ws(" ", "source", "lang"), F.array("lang", "source"), F.col("n_chars").cast("double"), F.lit(None))
    files = t.documents.select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("snippet_id"),
        F.concat_ws("/", "source", "doc_id").alias("filepath"),
        F.when(F.col("doc_id") % 2 == 0, headed).otherwise(F.col("text")).alias("text"),
    )
    known = t.labels.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("snippet_id"))
    new = ranking.register_new(files, known, F.expr(AS_OF))
    return new.withColumn("last_used", F.unix_seconds("last_used"))


@query("violating_copies", """
    SELECT count(*) AS rows_in_violating_pairs FROM documents d
    WHERE EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.source <> d.source)""")
def _(t: Tables) -> DataFrame:
    return copies(t).participants([VIOLATION]).agg(F.count(F.lit(1)).alias("rows_in_violating_pairs"))


@query("result_row_ids", """
    SELECT event_id, array_to_string(list_sort(list_distinct([event_id, event_id + 1, user_id,
      regexp_extract(props, '[0-9]+')::BIGINT])), ',') AS ids FROM events""")
def _(t: Tables) -> DataFrame:
    stored = F.format_string(
        '{"%s 17": [{"sum": [%d, %d.9], "ok": true}, {"compare": %d, "note": "row 5 \\"6\\""}, null], "more": %s}',
        F.col("event_type"), F.col("event_id"), F.col("event_id") + 1, F.col("user_id"), F.col("props"))
    ids = F.sort_array(text.result_row_ids(stored)).cast("array<string>")
    return t.events.select("event_id", F.array_join(ids, ",").alias("ids"))
