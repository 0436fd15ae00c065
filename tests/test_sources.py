"""Files, layers, payloads and logs."""

import json
import os
import threading

import duckdb
import pytest

import __spark_entry__ as entry
from arealis.operators import rank
from arealis.sources import registry, tables
from arealis.streaming import logs

SF = "/root/testdata/sf0.001"


def test_csv_keeps_leading_zeros_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("geoid,v\n01001,1\n")
    df = tables.read_table(spark, f"file://{tmp_path}/a.csv", as_string=True)
    assert df.first().geoid == "01001"
    tables.write_table(df, f"file://{tmp_path}/out.parquet")
    assert tables.read_table(spark, f"file://{tmp_path}/out.parquet").count() == 1


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"NAME": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    out = tables.read_geojson(spark, f"file://{tmp_path}/f.geojson", "NAME string").collect()
    assert [(r.NAME, r.part, len(r.rings[0])) for r in out] == [("a", 0, 4), ("b", 0, 4), ("b", 1, 4)]


def test_weights_of_a_markdown_table(spark, tmp_path):
    (tmp_path / "w.md").write_text("# Weights\n| factor | weight | direction |\n|---|---|---|\n| pop | 0.6 | higher |\n")
    assert [tuple(r) for r in tables.read_weights(spark, f"file://{tmp_path}/w.md").collect()] == [("pop", 0.6, "higher")]


def test_stream_equals_batch(spark, tmp_path):
    lines = [("a", "x", "stage_start", "2024-01-01T00:00:00Z"), ("a", "x", "stage_end", "2024-01-01T00:01:00Z"), ("a", "y", "stage_start", "2024-01-01T00:00:00Z")]
    (tmp_path / "log").mkdir()
    for i, r in enumerate(lines):
        (tmp_path / "log" / f"{i}.json").write_text(json.dumps(dict(zip(("run_id", "stage", "event", "ts"), r))) + "\n")
    q = logs.stream_stage_status(spark, f"file://{tmp_path}/log").writeStream.outputMode("complete").format("memory").queryName("status").start()
    q.processAllAvailable()
    q.stop()
    got = {r.stage: r.status for r in spark.table("status").collect()}
    batch = rank.stage_status(spark.read.schema(logs.LOG).json(f"file://{tmp_path}/log"), "run_id", "stage", "event", "ts")
    assert got == {r.stage: r.status for r in batch.collect()} == {"x": "completed", "y": "running"}


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 25


LIGHT = ["area_rate_ranked", "join_diagnostics", "summary_stats", "breaks_quantile", "site_scores", "count_within", "apportion", "gi_star", "d8", "text_rules"]


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda df: sorted(tuple("" if v is None or v != v else repr(float(v)) if not isinstance(v, str) else v for v in r) for r in df.itertuples(index=False))
    assert plain(got) == plain(want)


def test_registry_keeps_the_newest_of_each_layer(spark, tmp_path):
    r = registry.LayerRegistry(spark, f"file://{tmp_path}/layers")
    assert r.layers().count() == 0 and r.compact() == 0
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 3.0, -1.0), (3, None, None)], "id int, x double, y double")
    r.register("a", points)
    r.register("b", points.select("id"))
    r.register("a", points.where("id < 3"), "again")
    threads = [threading.Thread(target=r.register, args=(f"t{i % 3}", points.limit(i + 1))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    r.remove("b")
    r.remove("never there")

    def known():
        return {x.name: (x.geometry_type, x.n, x.xmin, x.ymax, x.note) for x in r.layers().collect()}

    before = known()
    assert before.keys() == {"a", "t0", "t1", "t2"} and before["a"] == ("point", 2, 0.0, 5.0, "again")
    assert r.meta("a").first().columns == "id:int, x:double, y:double" and r.meta("b").count() == 0
    assert [x.deleted for x in r.history("b").collect()] == [False, True]
    assert r.compact() >= 8 and known() == before
    r.register("b", points)
    assert known() == before | {"b": ("point", 3, 0.0, 5.0, None)}


def test_run_log(spark, tmp_path):
    log = registry.RunLog(spark, f"file://{tmp_path}/runs", "r1")
    df = spark.createDataFrame([(1, None), (2, "b"), (None, None)], "id int, `odd name` string")
    kept = log.watch(df, "read").where("id is not null")
    assert log.watch(kept, "kept").count() == 2
    failing = log.watch(df.selectExpr("raise_error('no') as x"), "fails")
    with pytest.raises(Exception, match="no"):
        failing.collect()
    log.close(10)
    got = {r.step: (r.rows, r.nulls) for r in log.rows().collect()}
    got.pop("fails", None)  # what a failed action has counted
    assert got == {"read": (3, {"id": 1, "odd name": 2}), "kept": (2, {"id": 0, "odd name": 1})}


def test_database_layer_is_read_by_ranges(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, i * 1.5, f"n{i % 7}") for i in range(1000)] + [(None, 0.5, "n1")]
    spark.createDataFrame(rows, "id int, v double, name string").write.jdbc(url, "places", properties=driver | {"createTableColumnTypes": "name VARCHAR(20)"})
    df = tables.read_layer(spark, url, "places", "v > 30 and name = 'n3'", driver, "id", 5)
    assert df.rdd.getNumPartitions() == 5
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(v,30.0)" in plan and "*EqualTo(name,n3)" in plan
    assert {r.id for r in df.collect()} == {i for i, v, n in rows if i is not None and v > 30 and n == "n3"}
    assert tables.read_layer(spark, url, "places", None, driver, "id", 3).count() == tables.read_layer(spark, url, "places", None, driver).count() == 1001
    assert tables.read_layer(spark, url, '(SELECT * FROM places WHERE "id" < 0) AS t', None, driver, "id").count() == 0
