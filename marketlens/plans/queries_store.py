"""Bound queries, batch 5: store maintenance. Runs <- ``orders`` (id, date),
their results <- ``lineitem``; the skill dimension has one row per part name."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import functions as F

from marketlens.operators import analysis, pipeline, skills, store
from marketlens.plans import bindings as b
from marketlens.plans.registry import query
from marketlens.session import checkpoint_dir, read_table


def _dimension(spark, d):
    p = read_table(spark, d, "part")
    return p.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


def _runs(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))


def _results(spark, d):
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("model_name"), F.col("l_linestatus").alias("target_type"),
        F.col("l_partkey").cast("string").alias("target_key"), F.col("l_linenumber").alias("horizon_months"), F.col("l_extendedprice").alias("predicted_value"))


# ------------------------------------------------------------------ H6, H3, C8
@query("delete_postings", "SELECT l_orderkey AS posting_id, count(DISTINCT l_partkey) AS n_links FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1")
def q_delete_postings(spark, d):
    p = b.postings(spark, d)
    _, left = skills.delete_postings(p, b.links(spark, d), p.where("id % 7 = 0").select("id"))
    return left.groupBy("posting_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("delete_skills", "SELECT l_partkey AS skill_id, count(DISTINCT l_orderkey) AS n_links FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1")
def q_delete_skills(spark, d):
    s = b.skills(spark, d)
    _, left = skills.delete_skills(s, b.links(spark, d), s.where("id % 5 = 0").select("id"))
    return left.groupBy("skill_id").agg(F.count(F.lit(1)).alias("n_links"))


@query("rebuild_links", """
WITH dim AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT DISTINCT l_orderkey AS posting_id, l_partkey AS skill_id FROM lineitem WHERE l_orderkey % 11 <> 0
UNION SELECT l_orderkey, dim.id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN dim ON dim.name = lower(p_name) WHERE l_orderkey % 11 = 0""")
def q_rebuild_links(spark, d):
    """Every eleventh posting is corrected: its skills are named anew, each
    name twice, and link to the dimension's row of that name."""
    touched = b.postings(spark, d).where("id % 11 = 0").select("id")
    named = b.links(spark, d).join(b.skills(spark, d).select(F.col("id").alias("skill_id"), "name"), "skill_id")
    named = touched.join(named, F.col("id") == F.col("posting_id")).groupBy("id").agg(F.collect_list("name").alias("n"))
    return skills.rebuild_links(b.links(spark, d), named.select("id", F.concat("n", "n").alias("skills"), F.concat("n", "n").alias("skills_en")), _dimension(spark, d))


@query("existing_skills", "SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1")
def q_existing_skills(spark, d):
    """All names of the table, upper-cased and padded, and as many unknown ones."""
    p = read_table(spark, d, "part")
    names = p.select(F.explode(F.array(F.concat(F.lit(" "), F.upper("p_name")), F.concat(F.lit("no such "), "p_name"), F.lit(""))).alias("name"))
    return skills.existing_for_names(_dimension(spark, d), names).select("name", "id")


# ------------------------------------------------------------------ A14
@query("posting_view", """
SELECT o_orderkey AS id, o_orderpriority AS role_title_en, coalesce(string_agg(DISTINCT p_name, '|' ORDER BY p_name), '') AS labels
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def q_posting_view(spark, d):
    v = pipeline.posting_view(b.postings(spark, d), b.links(spark, d), b.skills(spark, d))
    return v.select("id", "role_title_en", F.array_join("skill_labels", "|").alias("labels"))


@query("posting_lists", """
WITH l AS (SELECT l_orderkey AS id, l_partkey AS pk, min(l_linenumber) AS o FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS id, coalesce(string_agg(p_brand, '|' ORDER BY o, pk), '') AS skills, coalesce(string_agg(p_name, '|' ORDER BY o, pk), '') AS skills_en
FROM orders LEFT JOIN l ON l.id = o_orderkey LEFT JOIN part ON p_partkey = pk GROUP BY 1""")
def q_posting_lists(spark, d):
    links = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"), F.col("l_partkey").alias("skill_id"), "l_linenumber")
    v = pipeline.posting_lists(b.postings(spark, d), links, b.skills(spark, d), "l_linenumber")
    return v.select("id", F.array_join("skills", "|").alias("skills"), F.array_join("skills_en", "|").alias("skills_en"))


# ------------------------------------------------------------------ D19
@query("run_analysis", """
SELECT 'top_companies' AS analysis, label, n FROM (SELECT c_name AS label, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
UNION ALL SELECT 'top_roles', label, n FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
UNION ALL SELECT 'top_skills', label, n FROM (SELECT p_name AS label, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""")
def q_run_analysis(spark, d):
    """Three of the four analyses in one call."""
    postings = b.postings(spark, d).join(b.companies(spark, d), "company_id")
    found = analysis.run_analysis(postings, b.links(spark, d), b.skills(spark, d), ["top_skills", "top_roles", "top_companies", "no such"], 10)
    return reduce(lambda x, y: x.unionByName(y), [df.toDF("label", "n").select(F.lit(k).alias("analysis"), "label", "n") for k, df in found.items()])


# ------------------------------------------------------------------ F1, F4, H7, A7
@query("recent_runs", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def q_recent_runs(spark, d):
    return store.recent_runs(_runs(spark, d), store.RECENT_RUNS_LIMIT).select("id")


@query("latest_run_results", """
SELECT l_orderkey AS run_id, l_returnflag AS model_name, l_linenumber AS horizon_months, l_extendedprice AS predicted_value
FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def q_latest_run_results(spark, d):
    return store.latest_run_results(_runs(spark, d), _results(spark, d), store.RESULTS_LIMIT).select("run_id", "model_name", "horizon_months", "predicted_value")


@query("delete_run", """
SELECT o_orderkey AS run_id, count(l_orderkey) AS n_results FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey <> 7 GROUP BY 1""")
def q_delete_run(spark, d):
    runs, results = store.delete_run(_runs(spark, d), _results(spark, d), 7)
    n = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_results"))
    return runs.select(F.col("id").alias("run_id")).join(n, "run_id", "left").fillna(0, ["n_results"])


@query("review_applied", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'Corrected' ELSE o_orderpriority END AS role_title FROM orders WHERE o_orderkey % 1000 <> 7""")
def q_review_applied(spark, d):
    """Corrections, then deletions, on a table stored by id ranges; both are
    applied twice, which changes nothing. Only touched ranges are rewritten."""
    width = 1 << 14
    base = os.path.join(checkpoint_dir(spark), "postings-" + uuid.uuid4().hex)
    p = b.postings(spark, d).select("id", "role_title")
    store.write_ranges(p, base, width=width)
    fixes = p.where("id % 10 = 0").select("id", F.lit("Corrected").alias("new_title"))
    gone = p.where("id % 1000 = 7").select("id")

    def correct(old):
        return old.join(fixes, "id", "left").select("id", F.coalesce("new_title", "role_title").alias("role_title"))

    for k, (touched, change) in enumerate(((fixes, correct), (gone, lambda old: old.join(gone, "id", "left_anti"))) * 2):
        store.rewrite_ranges(spark, base, touched.select("id"), change, staging=f"{base}-staged-{k}", width=width)
    return spark.read.parquet(base).select("id", "role_title")
