"""Registered queries of sources and sinks: tables derived from the given ones are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.operators import groups
from rulespan.plans.batch import run_catalogue
from rulespan.plans.registry import Tables, query, verdict_sql
from rulespan.plans.rule_queries import CATALOGUE
from rulespan.session import shared_folder
from rulespan.sources import catalogue, corpus, loader, tables
from rulespan.sources.results import read_metrics, read_participants, write_results
from rulespan.sources.store import ResultStore

# ---- tables ----------------------------------------------------------------------------------------------

CELLS = """CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance,
    'line ' || c_nationkey || chr(10) || 'with "quotes", and commas' AS note"""


@query("table_csv", f"SELECT c_custkey AS id, {CELLS} FROM customer")
def _(t: Tables) -> DataFrame:
    """A table written as CSV and loaded by name: missing cells, line breaks, quotes, inferred types."""
    missing = F.when(F.col("c_custkey") % 20 == 0, F.lit("NA")).otherwise(F.lit("n/a"))
    made = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 0, missing).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.concat(F.lit("line "), "c_nationkey", F.lit('\nwith "quotes", and commas')).alias("note"))
    folder = shared_folder(t.spark, "csv")
    made.write.option("header", True).option("escape", '"').csv(f"{folder}/customer.csv")
    return tables.load_table(t.spark, folder, "Customer")


@query("table_set", """
    SELECT r_name, count(*) AS nations, (SELECT count(*) FROM supplier) AS suppliers, 2 AS found
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(t: Tables) -> DataFrame:
    """A table set, each as <name>.parquet or <name>; tables that don't exist are left out."""
    folder = shared_folder(t.spark, "set")
    tables.write_table(t.nation, f"{folder}/nation.parquet", "parquet")
    tables.write_table(t.region, f"{folder}/Region", "parquet")
    found = tables.load_tables(t.spark, folder, ["nation", "Region", "nobody", "nation"], fmt="parquet")
    tables.register({"set_nation": found["nation"], "set_region": found["Region"], "set_supplier": t.supplier})
    return t.spark.sql(
        f"""SELECT r_name, count(*) AS nations, (SELECT count(*) FROM set_supplier) AS suppliers, {len(found)} AS found
        FROM set_nation JOIN set_region ON n_regionkey = r_regionkey GROUP BY r_name""")


# ---- rules -----------------------------------------------------------------------------------------------

BRANDS = "(SELECT p_brand, 'b' || regexp_extract(p_brand, '[0-9]+') AS dataset, max(p_size) AS top FROM part GROUP BY p_brand)"


def brand_rules(t: Tables) -> DataFrame:
    """A rule file per brand, in a folder per dataset, read back."""
    made = t.part.groupBy("p_brand").agg(F.max("p_size").alias("top")).select(
        F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)).alias("dataset"), F.concat(F.lit("size "), "p_brand").alias("rule_id"),
        F.concat(F.lit("p_size <= "), "top").alias("rule"), F.lit("row").alias("rule_type"), F.array(F.lit("p_size")).alias("relevant_columns"))
    folder = shared_folder(t.spark, "rules")
    made.write.partitionBy("dataset").option("maxRecordsPerFile", 1).json(folder)
    return catalogue.load_rules(t.spark, folder, "*.json").withColumn("dataset", F.regexp_replace("dataset", "^dataset=", ""))


@query("rule_folders", f"SELECT dataset, 'size ' || p_brand AS rule_id, 'p_size <= ' || top AS rule, 'p_size' AS columns FROM {BRANDS}")
def _(t: Tables) -> DataFrame:
    return brand_rules(t).select("dataset", "rule_id", "rule", F.array_join("relevant_columns", ",").alias("columns"))


@query("pending_rules", f"SELECT dataset, 'size ' || p_brand AS rule_id FROM {BRANDS} WHERE top < 50 OR dataset < 'b3'")
def _(t: Tables) -> DataFrame:
    rules = brand_rules(t)
    done = rules.where("rule = 'p_size <= 50' AND dataset >= 'b3'").select("dataset", "rule_id")
    return catalogue.pending_rules(rules, done).select("dataset", "rule_id")


@query("split_valid", f"SELECT 'size ' || p_brand AS rule_id, dataset < 'b3' AS valid FROM {BRANDS}")
def _(t: Tables) -> DataFrame:
    rules = brand_rules(t)
    valid, missing = catalogue.split_valid(rules, rules.where("dataset < 'b3'").select("dataset").distinct())
    return valid.select("rule_id", F.lit(True).alias("valid")).unionAll(missing.select("rule_id", F.lit(False)))


@query("multi_table_rules", """
    SELECT row_number() OVER (ORDER BY n_nationkey)::VARCHAR AS rule_id, 'nation of ' || n_name AS rule_definition, 'customer' AS table1,
      n_regionkey / 10.0::DOUBLE AS violation_rate, n_nationkey % 2 + 1 AS instructions FROM nation""")
def _(t: Tables) -> DataFrame:
    """A JSON array of rules in one file; one instruction or a list of them."""
    one = F.struct(F.lit("customer").alias("table_to_modify"), F.struct(F.col("n_nationkey").alias("_id")).alias("record_to_add"))
    several = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.array(one, one)))
    head = F.to_json(F.struct(
        F.concat(F.lit("nation of "), "n_name").alias("rule_definition"), F.lit("customer").alias("table1"), F.lit("nation").alias("table2"),
        (F.col("n_regionkey") / 10).alias("violation_rate")))
    rule = F.concat(F.substring_index(head, "}", 1), F.lit(', "violation_data_generator": '), several, F.lit("}"))
    listed = t.nation.groupBy().agg(F.sort_array(F.collect_list(F.struct("n_nationkey", rule.alias("rule")))).alias("rules"))
    folder = shared_folder(t.spark, "multi")
    listed.select(F.concat(F.lit("["), F.array_join("rules.rule", ","), F.lit("]")).alias("value")).write.text(folder)
    rules = catalogue.load_multi_table_rules(t.spark, folder)
    count = F.size(F.from_json("violation_data_generator", "array<struct<table_to_modify string>>"))
    return rules.select("rule_id", "rule_definition", "table1", "violation_rate", count.alias("instructions"))


# ---- results ---------------------------------------------------------------------------------------------

SIDES = "SELECT p_partkey AS row_id, count(DISTINCT p_type) OVER (PARTITION BY p_name, p_brand) = 1 AS ok FROM part"


@query("result_files", f"SELECT 'fd' AS rule_id, row_id, {verdict_sql('ok')} AS verdict, round(avg((NOT ok)::INT) OVER (), 9) AS violation_rate FROM ({SIDES})")
def _(t: Tables) -> DataFrame:
    """Results as JSON files, read back."""
    result = groups.functional_dependency(t.part, ["p_name", "p_brand"], "p_type", row_id="p_partkey", rule_id="fd")
    folder = shared_folder(t.spark, "results")
    write_results(result, folder)
    rate = read_metrics(t.spark, folder).agg(F.round(F.max("violation_rate"), 9)).scalar()
    return read_participants(t.spark, folder).select("rule_id", "row_id", "verdict").withColumn("violation_rate", rate)


GROUP_SIDES = {
    "name_key": "SELECT c_custkey, count(*) OVER (PARTITION BY c_name) = 1 AS ok FROM customer",
    "name_balance": "SELECT c_custkey, min(c_acctbal) OVER (PARTITION BY c_name) >= 0 AS ok FROM customer",
    "nation_segment": "SELECT c_custkey, min(c_mktsegment) OVER w = max(c_mktsegment) OVER w AS ok FROM customer WINDOW w AS (PARTITION BY c_nationkey)",
    "balance": "SELECT c_custkey, c_acctbal >= 0 AS ok FROM customer",
    "segment": "SELECT c_custkey, regexp_matches(c_mktsegment, '^[A-Z]+$') AS ok FROM customer",
    "segment_known": "SELECT c_custkey, c_mktsegment IS NOT NULL AS ok FROM customer",
    "nation_exists": "SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation) AS ok FROM customer",
}


@query("rule_catalogue_rows", " UNION ALL ".join(
    f"SELECT '{rule_id}' AS rule_id, c_custkey::VARCHAR AS row_id, {verdict_sql('ok')} AS verdict FROM ({sides})" for rule_id, sides in GROUP_SIDES.items()))
def _(t: Tables) -> DataFrame:
    """The participants of a batch run, from its store; a second run of the same rules adds nothing."""
    known = {"customer": t.customer, "nation": t.nation}
    folder = shared_folder(t.spark, "store")
    run_catalogue(t.spark, CATALOGUE[:4], known, folder)
    run_catalogue(t.spark, CATALOGUE, known, folder)
    run_catalogue(t.spark, CATALOGUE, known, folder)
    return ResultStore(t.spark, folder).participants().select("rule_id", "row_id", "verdict")


# ---- texts -----------------------------------------------------------------------------------------------


@query("load_sources", """
    SELECT 'items' AS source, 'documentation' AS source_type, text, NULL AS error FROM benchmark
    UNION ALL SELECT 'site', 'web', trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), NULL FROM pages
    UNION ALL SELECT 'gone', NULL, NULL, 'failed' UNION ALL SELECT 'odd', NULL, NULL, 'failed'""")
def _(t: Tables) -> DataFrame:
    """Text files and pages by source. Sources without a path or of an unknown type are listed and don't stop the others."""
    folder = shared_folder(t.spark, "texts")
    # A file per text; the writer ends it with a line break.
    t.benchmark.select("text").write.option("maxRecordsPerFile", 1).option("lineSep", "\x00").text(f"{folder}/items")
    t.pages.select("url", "html").write.parquet(f"{folder}/site")
    found = loader.load_sources(t.spark, [
        loader.Source("items", "documentation", f"{folder}/items"), loader.Source("site", "web", f"{folder}/site", "API documentation"),
        loader.Source("gone", "code_snippet", f"{folder}/nowhere"), loader.Source("odd", "video", f"{folder}/items"),
        loader.Source("off", "documentation", f"{folder}/items", enabled=False)])
    texts = found.texts.select("source", "source_type", F.regexp_replace("text", "\x00$", "").alias("text"), F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return texts.unionAll(found.failures.select("source", none, none, F.lit("failed")))


@query("corpus_append", "SELECT source, count(DISTINCT text) AS texts FROM documents GROUP BY source")
def _(t: Tables) -> DataFrame:
    """A corpus that grew in two steps; the second holds all texts of the first again."""
    new = t.documents.select("source", F.lit("code_snippet").alias("source_type"), F.lit("").alias("description"), "text")
    folder = shared_folder(t.spark, "corpus")
    corpus.append_corpus(new.where("doc_id % 2 = 0"), folder)
    corpus.append_corpus(new, folder)
    return t.spark.read.parquet(folder).groupBy("source").agg(F.count_distinct("content").alias("texts"))


@query("corpus_append_twice", "SELECT 0::BIGINT AS added, count(DISTINCT (source, text)) AS texts FROM documents")
def _(t: Tables) -> DataFrame:
    """What a second append of the same texts adds, in rows, and the texts there are."""
    new = t.documents.select("source", F.lit("web").alias("source_type"), F.lit("Documentation").alias("description"), "text")
    folder = shared_folder(t.spark, "corpus")
    corpus.append_corpus(new, folder)
    before = t.spark.read.parquet(folder)
    rows = before.count()
    corpus.append_corpus(new, folder)
    after = t.spark.read.parquet(folder)
    return after.agg((F.count(F.lit(1)) - rows).alias("added"), F.count_distinct("source", "content").alias("texts"))
