"""Plans and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, capture, csv_ids, csv_items, selected, template
from ..operators.signature import identities
from ..plans import grid, validate
from ..schemas import PLANNED
from .registry import Register, table

register = Register()

_SUITES = ("libero_spatial", "libero_object", "libero_goal", "libero_10", "libero_90")


def _tasks(spark, sf_dir):
    """Parts as tasks of five suites."""
    part = table(spark, sf_dir, "part")
    suite = F.element_at(F.array(*[F.lit(s) for s in _SUITES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return part.select(
        suite.alias("suite"), none.alias("suite_variant"), none.alias("perturbation"), F.col("p_partkey").cast("long").alias("task_id"),
        F.col("p_partkey").cast("string").alias("task_key"), F.col("p_brand").alias("task_name"), F.col("p_type").alias("instruction"), none.alias("bddl_path"), none.alias("init_path"),
    )


_GRID = """
WITH t AS (SELECT ['libero_spatial','libero_object','libero_goal','libero_10','libero_90'][CAST(p_partkey % 5 + 1 AS BIGINT)] AS suite, * FROM part),
g AS (
  SELECT suite, p_partkey, p_brand, p_type, CAST(p_partkey AS VARCHAR) AS task_key, CAST(i AS BIGINT) AS init_state_id, CAST(7 AS BIGINT) AS seed,
         CAST(CASE suite WHEN 'libero_spatial' THEN 250 WHEN 'libero_object' THEN 280 WHEN 'libero_10' THEN 520 WHEN 'libero_90' THEN 400 ELSE 300 END AS BIGINT) AS max_steps
  FROM t, range(3) r(i)),
p AS (SELECT *, 'parts/' || suite || '/' || task_key || '/' || init_state_id || '/' || seed AS episode_id FROM g)
"""


def _plan(spark, sf_dir):
    return grid.expand_grid(_tasks(spark, sf_dir), "parts", "1", 3)


@register(_GRID + "SELECT 'e' || sha1(episode_id) AS episode_key, episode_id, suite, task_key, init_state_id, seed, max_steps FROM p")
def q_grid_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("episode_key", "episode_id", "suite", "task_key", "init_state_id", "seed", "max_steps")


@register(_GRID + """
SELECT suite, count(*) AS episodes, count(DISTINCT task_key) AS tasks, 'parts' AS benchmark, '1' AS benchmark_revision, min(seed) AS min_seed, max(seed) AS max_seed,
       max(max_steps) AS max_steps, 'closed-form@1' AS "function", 'runs' AS out, '8' AS batch
FROM p GROUP BY suite""")
def q_plan_summary(spark, sf_dir):
    """A dry run: what a run of the plan would do, with its configuration."""
    return validate.dry_run(_plan(spark, sf_dir), function="closed-form@1", out="runs", batch=8)


@register("""
WITH t AS (SELECT CAST(p_size % 10 AS BIGINT) AS task_id, min(p_brand) AS task_name, max(p_type) AS instruction FROM part GROUP BY 1),
p AS (SELECT *, CAST(i AS BIGINT) AS init_state_id, 'libero/libero_spatial/' || task_id || '/' || i || '/11' AS episode_id FROM t, range(50) r(i))
SELECT 'e' || sha1(episode_id) AS episode_key, episode_id, CAST(task_id AS VARCHAR) AS task_key, task_id, task_name, instruction, init_state_id, CAST(250 AS BIGINT) AS max_steps FROM p""")
def q_task_plan(spark, sf_dir):
    """A suite's plan from a registry of its ten tasks, made of all parts by size."""
    task = (F.col("p_size") % 10).cast("long").alias("task_id")
    tasks = table(spark, sf_dir, "part").groupBy(task).agg(F.min("p_brand").alias("task_name"), F.max("p_type").alias("instruction"))
    none = F.lit(None).cast("string")
    registry = tasks.select(F.lit("libero_spatial").alias("suite"), "task_id", "task_name", "instruction", none.alias("bddl_path"), none.alias("init_path"))
    plan = grid.task_plan(registry, "libero_spatial", seed=11)
    return plan.select("episode_key", "episode_id", "task_key", "task_id", "task_name", "instruction", "init_state_id", "max_steps")


_DIGEST = """sha256('{"bddl_path":null,"benchmark":"parts","benchmark_revision":"1","episode_id":"' || episode_id || '","episode_key":"e' || sha1(episode_id) ||
  '","init_path":null,"init_state_id":' || init_state_id || ',"instruction":"' || p_type || '","max_steps":' || max_steps || ',"perturbation":null,"seed":' || seed ||
  ',"suite":"' || suite || '","suite_variant":null,"task_id":' || p_partkey || ',"task_key":"' || task_key || '","task_name":"' || p_brand || '"}')"""


@register(_GRID + f"""
, b AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS b, sha256(string_agg({_DIGEST}, chr(10) ORDER BY episode_id)) AS d FROM p GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS content_hash FROM b""")
def q_plan_hash(spark, sf_dir):
    """All columns of the plan; buckets of 150 rows."""
    return validate.bucketed_hash(_plan(spark, sf_dir), validate.row_digest(*PLANNED), F.col("episode_id"), F.floor(F.col("task_id") / 50).cast("long"))


@register("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, o_orderkey) - 1 AS episode_index FROM orders""")
def q_plan_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return validate.dense_index(orders, "o_orderstatus", "o_orderpriority", "o_orderkey", window_rows=10_000).select("o_orderkey", "episode_index")


@register("""
SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 8) AS BIGINT) AS cohort FROM orders""")
def q_plan_cohorts(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey")
    return validate.cohorts(left, 8, "o_orderkey")


@register("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_plan_violations(spark, sf_dir):
    return validate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@register("""
SELECT count(*) AS n_rows, count(*) - count(l_orderkey) AS null_episode_key, count(*) - count(l_linenumber) AS null_seed,
       count(DISTINCT l_orderkey) AS n_keys, count(DISTINCT l_partkey) AS n_ids FROM lineitem""")
def q_plan_problems(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode_key"), F.col("l_partkey").alias("episode_id"), F.lit("s").alias("suite"), F.lit("t").alias("task_key"), F.lit(0).alias("init_state_id"), F.col("l_linenumber").alias("seed")
    )
    return validate.problems(lines).select("n_rows", "null_episode_key", "null_seed", "n_keys", "n_ids")


_URL = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)\.html"


@register(f"""
SELECT page_id, regexp_extract(url, '{_URL}', 1) AS host, regexp_extract(url, '{_URL}', 2) AS lang, CAST(regexp_extract(url, '{_URL}', 3) AS BIGINT) AS number
FROM pages WHERE regexp_matches(url, '{_URL}')""")
def q_catalog_parse(spark, sf_dir):
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").where(url.rlike(_URL))
    return pages.select("page_id", capture(url, _URL, 1).alias("host"), capture(url, _URL, 2).alias("lang"), capture(url, _URL, 3).try_cast("long").alias("number"))


@register("""
SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, count(*) AS n_pages FROM pages
WHERE regexp_matches(url, '^https?://[^/]+/([a-z]{2})/') GROUP BY 1""")
def q_catalog_summary(spark, sf_dir):
    lang = capture(F.col("url"), "^https?://[^/]+/([a-z]{2})/")
    return table(spark, sf_dir, "pages").select(lang.alias("lang")).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n_pages")).orderBy("lang")


@register(r"SELECT page_id, nullif(regexp_extract(html, '(?s)<title>\s*(.+?)\s*</title>', 1), '') AS instruction FROM pages")
def q_instruction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", capture(F.col("html"), r"(?s)<title>\s*(.+?)\s*</title>").alias("instruction"))


@register("""
WITH s AS (SELECT * FROM supplier WHERE s_acctbal >= 9000),
own AS (SELECT s_nationkey AS k, min(s_suppkey) AS v FROM s GROUP BY 1),
near AS (SELECT n_regionkey AS k, min(s_suppkey) AS v FROM s JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(own.v, near.v) AS supplier FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN own ON own.k = c_nationkey LEFT JOIN near ON near.k = n_regionkey""")
def q_fallback_pair(spark, sf_dir):
    """A supplier with a high balance of the customer's nation, or else of its region: one lookup table with both kinds of keys. Many nations have none."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    few = table(spark, sf_dir, "supplier").where("s_acctbal >= 9000").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    keyed = few.select(F.explode(F.array(template("nation {}", F.col("n_nationkey")), template("region {}", F.col("n_regionkey")))).alias("key"), F.col("s_suppkey").alias("hit"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select("c_custkey", template("nation {}", F.col("c_nationkey")).alias("_own"), template("region {}", F.col("n_regionkey")).alias("_near"))
    return grid.two_tier(rows, keyed, "_own", "_near", "key", "hit", "supplier").select("c_custkey", "supplier")



@register("""
SELECT p_partkey, p_brand, p_type FROM part
WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey <= 3) OR p_size IN (1, 2, 3)""")
def q_selectors(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brands = [r[0] for r in part.where("p_partkey <= 3").select("p_brand").distinct().collect()]
    return part.where(selected(F.col("p_brand"), brands) | selected(F.col("p_size"), [1, 2, 3])).select("p_partkey", "p_brand", "p_type")


@register("""
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || ', ' || p_size || ',' ELSE p_brand || ',, ' || p_size END AS t FROM part),
i AS (SELECT p_partkey, list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM s)
SELECT p_partkey, array_to_string(items, '|') AS items,
       CASE WHEN len(list_filter(items, lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 THEN CAST(list_sum(list_transform(list_filter(items, lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS BIGINT))) AS BIGINT) END AS id_sum FROM i""")
def q_selector_lists(spark, sf_dir):
    """Comma-separated selectors: ids if all are numbers, else keys."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(key % 2 == 0, template("{}, {},", key, size)).otherwise(template("{},, {}", F.col("p_brand"), size))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    total = F.aggregate(csv_ids(F.col("t")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("p_partkey", F.array_join(csv_items(F.col("t")), "|").alias("items"), total.alias("id_sum"))


@register("""
SELECT doc_id, substr(source, 4) AS source_number, lang FROM documents WHERE starts_with(source, 'src1') AND contains(lang, 'e')""")
def q_prefix_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.where(F.col("source").startswith("src1") & F.col("lang").contains("e")).select("doc_id", F.substr("source", F.lit(4)).alias("source_number"), "lang")


@register("""
SELECT c_custkey, substr(sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}'), 1, 16) AS run_id FROM customer""")
def q_run_identity(spark, sf_dir):
    names = ("c_custkey", "c_mktsegment", "c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", identities(None, *names).alias("run_id"))


@register("""
SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS text FROM orders""")
def q_canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", canonical_json("o_orderstatus", "o_orderkey", "o_orderpriority").alias("text"))
