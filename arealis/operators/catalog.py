"""Freshness, staleness and text searches over catalogs and reports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(sources: DataFrame, as_of: str) -> DataFrame:
    """``sources(…, frequency, threshold_days, last_date, next_release)``: STALE, OK or UNKNOWN on a day.

    ``next_release`` is text, a year (taken as its first of July) or a year and month;
    other texts are ignored. Once that day has come, a newer vintage is likely there.
    Sources of frequent cadence are stale by their own threshold, 365 days if it is null,
    and unknown without a date of retrieval.
    """
    r, day = F.col("next_release"), F.lit(as_of).cast("date")
    release = F.when(r.rlike(r"^\d{4}$"), F.concat(r, F.lit("-07-01"))).when(r.rlike(r"^\d{4}-\d{2}$"), F.concat(r, F.lit("-01"))).try_cast("date")
    age = F.datediff(day, F.col("last_date"))
    frequent = F.col("frequency").isin("continuous", "monthly", "quarterly")
    late = age > F.coalesce("threshold_days", F.lit(365))
    status = F.when(release <= day, "STALE").when(frequent & F.col("last_date").isNull(), "UNKNOWN").when(frequent & late, "STALE").otherwise("OK")
    return sources.withColumns({"age_days": age, "freshness": status})


def detect_sources(logs: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """``keywords(source, keyword)``, a list written by hand: which sources each text mentions."""
    return logs.select(key, F.col(text).alias("_text")).join(_listed(keywords), F.lower("_text").contains(F.lower("keyword"))).select(key, "source").distinct()


def staleness(used: DataFrame, sources: DataFrame) -> DataFrame:
    """Vintages that each use lies behind the newest; two or more are major."""
    j = used.join(sources, "source")
    behind = F.greatest(F.col("latest").try_cast("int") - F.col("vintage").try_cast("int"), F.lit(0))
    return j.withColumn("behind", behind).withColumn("major", F.col("behind") >= 2)


def impact(stale: DataFrame) -> DataFrame:
    """Score and severity of ``(project, criticality, is_primary, behind, major)``, the worst of a project."""
    # Points and severity bounds.
    s = F.when(F.col("criticality") == "high", 0.5).when(F.col("criticality") == "medium", 0.3).otherwise(0.1)
    s = s + F.when(F.col("is_primary"), 0.25).otherwise(0.0)
    s = s + F.when(F.col("behind") >= 3, 0.2).when(F.col("behind") == 2, 0.15).when(F.col("behind") == 1, 0.05).otherwise(0.0)
    s = F.least(s + F.when(F.col("major"), 0.1).otherwise(0.0), F.lit(1.0))
    out = stale.withColumn("score", F.round(s, 2)).groupBy("project").agg(F.max("score").alias("score"))
    return out.withColumn("severity", F.when(F.col("score") >= 0.7, "critical").when(F.col("score") >= 0.5, "high").when(F.col("score") >= 0.3, "medium").otherwise("low"))


def search_inventory(df: DataFrame, project: str, text: Sequence[str], needle: str) -> DataFrame:
    """Projects whose texts, taken together, contain ``needle`` in any case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *text)), F.lit(needle.lower()))).select(project).distinct()


def search(df: DataFrame, query: str, k: int, tie: str, id_col: str, name: str, brief: str, full: str, uses: str | None = None, category: str | None = None) -> DataFrame:
    """Rows by a query: its whole text in id, name and category, and each of its words in id, name and texts."""
    low = lambda c: F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))
    q, terms = query.lower(), re.findall(r"\w+", query.lower())
    # Points of each field.
    whole = [(id_col, 10.0), (name, 8.0), *([(category, 2.0)] if category else [])]
    part = [(id_col, 3.0), (name, 2.0), (brief, 1.5), (full, 1.0), *([(uses, 0.5)] if uses else [])]
    score: Column = F.lit(0.0)
    for c, points, needle in [(c, p, q) for c, p in whole] + [(c, p, w) for c, p in part for w in terms]:
        score = score + F.when(low(c).contains(needle), points).otherwise(0.0)
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), tie).limit(k)


def facet_filter(df: DataFrame, **facets) -> DataFrame:
    """Rows with the given values; ``column=True`` asks for any value."""
    for c, v in facets.items():
        df = df.where(F.col(c).isNotNull() if v is True else F.col(c) == v)
    return df


#: Rows that a list written by hand may have; it is broadcast and every text is searched for all of it.
LISTED = 10_000


def _listed(rows: DataFrame) -> DataFrame:
    if (n := rows.limit(LISTED + 1).count()) > LISTED:
        raise ValueError(f"a list of keywords has {LISTED} rows at most, this one has {n} or more")
    return F.broadcast(rows)


def match_citation(df: DataFrame, registry: DataFrame, text: str) -> DataFrame:
    """The first citation by ``ordinal`` whose keyword occurs; ``registry`` is a list written by hand."""
    key = "_row"
    rows = df.withColumn(key, F.xxhash64(text))
    hits = rows.select(key, text).distinct().join(_listed(registry), F.lower(text).contains(F.lower("keyword"))).groupBy(key, text).agg(F.min_by("citation", "ordinal").alias("citation"))
    return rows.join(hits, [key, text], "left").drop(key)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def inventory(assets: DataFrame, manifests: DataFrame, inspections: DataFrame) -> DataFrame:
    """Assets with what manifests and inspections say of the same file stem."""
    a = assets.withColumn("stem", stem(F.col("path")))
    m = manifests.select(stem(F.col("path")).alias("stem"), F.lit(True).alias("has_manifest")).distinct()
    i = inspections.select(stem(F.col("path")).alias("stem"), F.col("rows").alias("inspected_rows")).groupBy("stem").agg(F.max("inspected_rows").alias("inspected_rows"))
    return a.join(m, "stem", "left").join(i, "stem", "left").withColumn("has_manifest", F.coalesce("has_manifest", F.lit(False)))


def lineage(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``log(step, inputs, outputs)``: input to step, step to output.

    Steps without files are nodes, too: ``orphans`` finds those without an edge.
    """
    into = log.select(F.explode("inputs").alias("src"), F.col("step").alias("dst"))
    out = log.select(F.col("step").alias("src"), F.explode("outputs").alias("dst"))
    edges = into.unionByName(out).distinct()
    made, used = log.select(F.explode("outputs").alias("node")).distinct(), log.select(F.explode("inputs").alias("node")).distinct()
    files = made.withColumn("m", F.lit(True)).join(used.withColumn("u", F.lit(True)), "node", "full_outer")
    kind = F.when(F.col("m") & F.col("u"), "intermediate").when(F.col("m"), "output").otherwise("input")
    nodes = files.select("node", kind.alias("kind")).unionByName(log.select(F.col("step").alias("node"), F.lit("operation").alias("kind")).distinct())
    return nodes, edges


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge begins or ends at."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    return nodes.join(ends, "node", "left_anti")
