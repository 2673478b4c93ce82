"""Skill dimension upsert and link rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.text import once, optional_stripped, py_strip


def skill_mentions(postings: DataFrame, *, id_col="id", skills_col="skills", skills_en_col="skills_en") -> DataFrame:
    """Explode (skills, skills_en) into mentions (posting_id, pos, original,
    english, name) with the lower-cased English name as the skill key."""
    ex = postings.select(F.col(id_col).alias("posting_id"),
                         F.posexplode(F.arrays_zip(F.col(skills_col).alias("s"), F.col(skills_en_col).alias("x"))).alias("pos", "p"))
    m = once(ex, "posting_id", "pos", py_strip(F.coalesce("p.s", F.lit(""))).alias("o"), optional_stripped(F.coalesce("p.x", "p.s")).alias("e"))
    english = F.coalesce("e", "o")
    m = m.select("posting_id", "pos", F.when(F.col("o") == "", english).otherwise(F.col("o")).alias("original"), english.alias("english"))
    return m.where(F.col("english") != "").withColumn("name", F.lower("english"))


def upsert_skills(store: DataFrame, mentions: DataFrame, seq_col: str = "posting_id") -> DataFrame:
    """H2: get-or-create by name. A new skill keeps its first-seen display
    label (earliest ``seq_col``, then position); an existing skill keeps its
    row and only gets a missing English label filled. New ids are a 64-bit
    hash of the name (no global sequence)."""
    firsts = mentions.groupBy("name").agg(
        F.min_by(F.struct("original", "english"), F.struct(F.col(seq_col), F.col("pos"))).alias("f"))
    s = store.select("id", "name", "display_name", "display_name_en")
    merged = s.join(firsts, "name", "full_outer")
    return merged.select(
        F.coalesce(F.col("id"), F.xxhash64("name")).alias("id"),
        "name",
        F.coalesce(F.col("display_name"), F.col("f.original")).alias("display_name"),
        F.coalesce(F.nullif(F.col("display_name_en"), F.lit("")), F.col("f.english")).alias("display_name_en"),
    )


def existing_for_names(store: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """Stored skills for a set of names (semi-join on distinct lowered names)."""
    keys = names.select(F.lower(py_strip(name_col)).alias("name")).where(F.col("name") != "").distinct()
    return store.join(keys, "name", "left_semi")


def rebuild_links(links: DataFrame, postings: DataFrame, skills: DataFrame, *, id_col="id",
                  skills_col="skills", skills_en_col="skills_en") -> DataFrame:
    """H3: replace the links of the given postings: old links of those
    postings are dropped (anti-join), the new list is exploded and joined to
    the skill dimension by name; a repeated name links once (Q19)."""
    touched = postings.select(F.col(id_col).alias("posting_id"))
    kept = links.join(touched, "posting_id", "left_anti")
    new = skill_mentions(postings, id_col=id_col, skills_col=skills_col, skills_en_col=skills_en_col)
    new = new.join(skills.select(F.col("id").alias("skill_id"), "name"), "name").select("posting_id", "skill_id")
    return kept.select("posting_id", "skill_id").unionByName(new).distinct()


def delete_postings(postings: DataFrame, links: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """H6: drop postings by id and their links (anti-joins)."""
    gone = ids.select(F.col(id_col).alias("_id"))
    return (postings.join(gone, postings[id_col] == gone["_id"], "left_anti"),
            links.join(gone, links["posting_id"] == gone["_id"], "left_anti"))


def delete_skills(skills: DataFrame, links: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """H6 for skills: drop skills by id and their links."""
    gone = ids.select(F.col(id_col).alias("_id"))
    return (skills.join(gone, skills["id"] == gone["_id"], "left_anti"),
            links.join(gone, links["skill_id"] == gone["_id"], "left_anti"))
