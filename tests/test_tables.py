"""Hand-worked cases of the table layer."""

import math

import pytest
from pyspark.sql import functions as F

from arealis.functions.columns import break_label, clean_name, smart_round, to_numeric
from arealis.functions import geometry as g
from arealis.operators import catalog, classify, clean, joins, profile, quality, rank, rates, reports


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rate_with_margin_and_reliability(spark):
    df = spark.createDataFrame([(1, 50.0, 200.0, 10.0, 20.0), (2, 5.0, 0.0, 1.0, 1.0), (3, 10.0, 100.0, None, 5.0), (4, 1.0, 100.0, 9.0, 5.0)], "id int, num double, den double, mn double, md double")
    out = {r.id: r for r in rates.compute_rate(df, "num", "den", "rate", "mn", "md").collect()}
    assert out[1].rate == 25 and math.isclose(out[1].rate_moe, math.sqrt(100 + 25) / 200 * 100) and out[1].rate_reliable
    assert out[2].rate is None and out[2].rate_reliable is False
    assert out[3].rate_moe is None and out[3].rate_reliable is True
    assert out[4].rate_reliable is False


def test_reliability_classes_and_bounds(spark):
    m = 1.645
    df = spark.createDataFrame([("zero", 0.0, 1.0), ("null", None, 1.0), ("none", 10.0, 11.0), ("equal", 10.0, 10.0), ("good", 100.0, 14.0 * m), ("fifteen", 100.0, 15.001 * m), ("thirty", 100.0, 30.001 * m)], "k string, e double, m double")
    got = {r.k: r.reliability for r in rates.reliability(df, "e", "m").collect()}
    assert got == {"zero": "Effectively Zero", "null": "Effectively Zero", "none": "Essentially Meaningless", "equal": "Unreliable", "good": "Reliable", "fifteen": "Use with Caution", "thirty": "Unreliable"}


def test_key_join_keeps_zeros_and_never_matches_nulls(spark):
    a = spark.createDataFrame([("01", 1), ("1", 2), (None, 3), ("x", 4)], "k string, v int")
    b = spark.createDataFrame([("01", 10), (None, 20), ("01", 30), ("z", 40)], "key string, v int")
    out = sorted(rows(joins.join_data(a, b, "k", "key").select("k", "v_x", "v_y")), key=str)
    assert out == sorted([("01", 1, 10), ("01", 1, 30), ("1", 2, None), (None, 3, None), ("x", 4, None)], key=str)
    d = joins.join_diagnostics(a, b, "k", "key").first()
    assert (d.left_rows, d.matched, d.left_only, d.right_only, d.right_duplicates) == (3, 1, 2, 1, 1)


def test_batch_join_prefixes_collisions_and_skips(spark):
    base = spark.createDataFrame([(1, 5)], "k int, v int")
    t = spark.createDataFrame([(1, 7)], "k int, v int")
    out = joins.batch_join(base, {"t": t, "none": t.drop("k")}, "k")
    assert out.columns == ["k", "v", "t_v"] and rows(out) == [(1, 5, 7)]


def test_coercion_is_all_or_nothing(spark):
    df = spark.createDataFrame([("1", "2"), ("x", "3")], "a string, b string")
    assert dict(clean.coerce_types(df, {"a": "int", "b": "int"}).dtypes) == {"a": "string", "b": "int"}
    assert rows(df.select(to_numeric(F.col("a")))) == [(1.0,), (None,)]


def test_names_and_rounding(spark):
    assert clean_name("  Total Pop (2020)% ") == "total_pop_2020"
    df = spark.createDataFrame([(2.5, 1234.5, 0.125)], "a double, b double, c double")
    assert rows(df.select(smart_round(F.col("a"), "pop"), smart_round(F.col("b"), "v"), smart_round(F.col("c"), "v"))) == [(2.0, 1234.0, 0.12)]


def test_breaks_and_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)], "v double")
    assert classify.breaks(df, "v", 5) == [1, 3, 5, 7, 9, 10]
    assert classify.breaks(df, "v", 3, "equal_interval") == [1, 4, 7, 10]
    constant = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert classify.breaks(constant, "v", 2) == [2, 3]
    assert classify.breaks(constant.limit(0), "v", 2) == []
    got = [r["class"] for r in classify.classify(df, "v", 5).orderBy("v").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_ranks_equal_a_plain_sort(spark):
    import random

    rng = random.Random(1)
    data = [(i, rng.choice([None, 1.0, 2.0, rng.random() * 5])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, v double")
    got = {r.id: r["rank"] for r in rank.row_rank(df, "v", ["id"], descending=True).collect()}
    order = sorted((x for x in data if x[1] is not None), key=lambda x: (-x[1], x[0]))
    assert got == {i: k + 1 for k, (i, _) in enumerate(order)} | {i: None for i, v in data if v is None}


def test_constant_factor_scores_half(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0)], "id int, a double, b double")
    out = {r.id: r.score for r in rank.score_sites(df, {"a": (1.0, "lower"), "b": (1.0, "higher")}, "id").collect()}
    assert out == {1: 25.0, 2: 75.0}


def test_change_and_rollup(spark):
    b = spark.createDataFrame([("1", 0.0), ("2", 10.0)], "geoid string, v double")
    c = spark.createDataFrame([(1, 5.0), (2, 15.0)], "GEOID int, v double")
    got = {r.geoid: (r.v_change, r.v_change_pct) for r in rates.change_detection(b, c, ["v"], "geoid").collect()}
    assert got == {"1": (5.0, None), "2": (5.0, 50.0)}
    with pytest.raises(ValueError):
        profile.rollup(b, c, "geoid", "x", ["v"], medians=["m"])


def test_quality_and_text_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, v double")
    checks = quality.check_rows(df, 5).unionByName(quality.check_nulls(df, ["v"], 10)).unionByName(quality.check_required(df, ["id", "no"]))
    assert rows(quality.overall(checks)) == [(1, 1, 2, "FAIL")]


def test_report_rules(spark):
    texts = {
        1: "Eviction rates rose\nBecause of crime, evictions fell",  # topics in the order of the brief
        2: "Income here is lower than expected\nincome is as always\nNot the income, though",
        3: "Poverty is caused by race.\nRace is correlated with what causes poverty\nCauses. And then race\nHispanic families: this predicts income\nblackbird causes",
        4: "The city should act\na\nb\nc\nThe city should act\nd\nthis is based on counts\nmustard",
        5: "The highest rate\nis here (Table 2)\nThe worst of all\n\nIt is almost done\nthe best [3]",
        6: "this may suggest growth\n## Key Findings\nit seems to show less\nit seems",
        7: "",
        8: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    hits = reports.scan_report(docs, "id", "text", ["crime", "Eviction"], "Income growth is slow", ["all grows"])
    found = {(r.id, r.line_no, r.rule): (r.severity, r.matched, r.in_key_section) for r in hits.collect()}
    assert found == {
        (1, 1, "sensitive_topic"): ("WARN", "Eviction", None),
        (1, 2, "sensitive_topic"): ("WARN", "crime", None),
        (2, 1, "hero_contradicts_belief"): ("WARN", None, None),
        (3, 1, "race_causal_language"): ("FAIL", "caused by race", None),
        (3, 4, "race_causal_language"): ("FAIL", "Hispanic families: this predicts", None),
        (4, 1, "policy_without_disclaimer"): ("WARN", None, None),
        (5, 3, "superlative_without_citation"): ("WARN", "worst", None),
        (6, 1, "policy_without_disclaimer"): ("WARN", None, None),  # "suggest" is one of its verbs
        (6, 1, "passive_uncertainty"): ("INFO", "may suggest", False),
        (6, 3, "passive_uncertainty"): ("INFO", "seems to show", True),
    }
    assert {r.id: r.status for r in reports.report_status(hits, "id").collect()} == {1: "WARN", 2: "WARN", 3: "FAIL", 4: "WARN", 5: "WARN", 6: "WARN"}
    plain = reports.scan_report(docs, "id", "text")
    assert {r.rule for r in plain.select("rule").distinct().collect()} == {"race_causal_language", "policy_without_disclaimer", "superlative_without_citation", "passive_uncertainty"}


def test_dots_stay_inside(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    shapes = [(1, [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))], 3000.0), (2, [ring((0, 0), (3, 0), (0, 1))], 26.0), (3, [ring((0, 0), (1, 1), (2, 2))], 50.0), (4, None, 50.0), (5, [ring((0, 0), (1, 0), (1, 1))], None)]
    df = spark.createDataFrame(shapes, "id int, rings array<array<struct<x:double,y:double>>>, n double")
    dots = classify.dots_inside(df, "n", 10.0, "id").join(df, "id").withColumn("in", g.contains(F.col("rings"), F.col("x"), F.col("y"))).toPandas()
    assert dots.groupby("id").size().to_dict() == {1: 300, 2: 3} and dots["in"].all()
    assert 110 < (dots[dots.id == 1].y < 2).sum() < 190  # as much as its area
    assert classify.dot_unit(df, ["n"], 100) == 31.26 and classify.dot_unit(df.limit(0), ["n"]) == 1.0


def test_grades_and_orphans(spark):
    scores = spark.createDataFrame([(s,) for s in (95, 90, 89, 70, 60, 59, None)], "s int")
    assert [r.g for r in scores.select(quality.grade(F.col("s")).alias("g")).collect()] == ["A", "A", "B", "C", "D", "F", None]
    log = spark.createDataFrame([("a", ["x"], ["y"]), ("b", [], []), ("c", None, None)], "step string, inputs array<string>, outputs array<string>")
    assert {r.node for r in catalog.orphans(*catalog.lineage(log)).collect()} == {"b", "c"}


def test_stage_status(spark):
    log = spark.createDataFrame([("a", "x", "stage_start", "2024-01-01 00:00:00"), ("a", "x", "stage_end", "2024-01-01 00:01:00"), ("a", "y", "stage_start", "2024-01-01 00:00:00"), ("a", "z", "stage_end", "2024-01-01 00:00:00"), ("a", "w", "stage_start", "2024-01-01 00:00:00"), ("a", "w", "stage_start", "2024-01-01 00:00:05")], "run string, stage string, event string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.stage: (r.status, r.seconds) for r in rank.stage_status(log, "run", "stage", "event", "ts").collect()}
    assert got == {"x": ("completed", 60), "y": ("running", None), "z": ("pending", None), "w": ("restarted", None)}


def test_reference_rules(spark):
    df = spark.createDataFrame([(9.075, 2.5, 1234.5, 0.126)], "a double, b double, c double, d double")
    got = df.select(smart_round(F.col("a"), "poverty_rate"), smart_round(F.col("b"), "count"), smart_round(F.col("a"), "rent"), smart_round(F.col("c"), "x"), smart_round(F.col("d"), "x"))
    assert rows(got) == [tuple(float(round(v, n)) for v, n in ((9.075, 2), (2.5, 0), (9.075, 0), (1234.5, 0), (0.126, 2)))]
    labels = df.select(break_label(F.lit(0.5), F.lit(12.25)), break_label(F.lit(99.5), F.lit(12345.6), percent=True))
    assert rows(labels) == [("0.50\u201312.2", "99.5\u201312,346%")]
    names = spark.createDataFrame([("Fort Hood",), ("State Penitentiary",), ("Jail",)], "name string")
    assert [r.institutional for r in clean.flag_institutional(names, "name").collect()] == [True, True, False]
    sources = spark.createDataFrame([("annual", None, None, "2001"), ("annual", None, None, "2000-06"), ("monthly", 60, "2000-04-01", None), ("monthly", None, "2000-04-01", "soon"), ("quarterly", 90, None, None)], "frequency string, threshold_days int, last_date string, next_release string")
    sources = sources.withColumn("last_date", F.to_date("last_date"))
    assert [r.freshness for r in catalog.freshness(sources, "2000-07-01").collect()] == ["OK", "STALE", "STALE", "OK", "UNKNOWN"]
    cells = spark.createDataFrame([(1, None), (2, 1.0), (3, 2.0), (4, 3.0)], "a int, b double")
    assert rows(quality.quality_points(cells, ["a", "b"])) == [(30, 30, 12.5)] and rows(quality.quality_points(cells, ["b"])) == [(20, 30, 25.0)]
    tools = spark.createDataFrame([("gdal:slope", "Slope", "slope of a raster", "angle", "terrain use"), ("x", "Aspect", "direction", "slope too", None)], "id string, name string, brief string, full string, uses string")
    assert [(r.id, r.score) for r in catalog.search(tools, "slope, use", 5, "id", "id", "name", "brief", "full", "uses").collect()] == [("gdal:slope", 3 + 2 + 1.5 + 0.5), ("x", 1.0)]


def test_natural_breaks_put_every_value_to_its_nearest_mean(spark):
    values = [1.0, 1.0, 2.0, 2.5, 9.0, 10.0, 10.5, 11.0, 30.0, 31.0, 33.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert classify.natural_breaks(df, "v", 3) == [1.0, 2.5, 11.0, 33.0]
    assert classify.natural_breaks(df.where("v < 0"), "v", 3) == []
    assert classify.natural_breaks(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 3) == classify.breaks(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v", 3)


def test_shares_densities_and_renumbering(spark):
    df = spark.createDataFrame([(3, 5, None, 10, 2.0), (1, 1, 1, 0, 0.0), (7, 4, 2, 12, None)], "k int, a int, b int, total int, area double")
    out = {r.k: r for r in rates.density(rates.share_of_parts(df, ["a", "b", "absent"], "total", "pct"), "total", "area", "d").collect()}
    assert (out[3].pct, out[3].d) == (50.0, 5.0) and (out[1].pct, out[1].d) == (None, None) and (out[7].pct, out[7].d) == (50.0, None)
    assert {r.k: r.zone_id for r in rank.renumber(df, "k").collect()} == {1: 1, 3: 2, 7: 3}
