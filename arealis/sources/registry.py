"""A registry of layers as rows that are only ever added, and logs of runs."""

from __future__ import annotations

import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ENTRY = "name string, geometry_type string, n long, xmin double, ymin double, xmax double, ymax double, columns string, note string, deleted boolean, at timestamp, id string"
_RUN = "run string, step string, rows long, nulls map<string,long>, at timestamp"


class LayerRegistry:
    """What is known of layers, under a folder that Spark can write.

    A change adds a row in a folder of its own, so writers neither wait for nor overwrite
    each other; of the rows of a name the newest holds, ties to the larger ``id``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(self.root)
        except AnalysisException as e:  # nothing has been added yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _ENTRY)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("name", "at", "id")]
        return rows.groupBy("name").agg(F.max(F.struct("at", "id", *rest)).alias("m")).select("name", "m.*").select(*rows.columns)

    def _add(self, row: DataFrame) -> None:
        row = row.withColumns({"at": F.current_timestamp(), "id": F.lit(uuid.uuid4().hex)})
        row.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in _ENTRY.split(", "))).write.parquet(f"{self.root}/{uuid.uuid4().hex}")

    def register(self, name: str, layer: DataFrame, note: str | None = None) -> None:
        """Add or replace what is known of a layer: kind, rows, bounds, columns; it is read once."""
        boxed, dotted = {"xmin", "ymin", "xmax", "ymax"} <= set(layer.columns), {"x", "y"} <= set(layer.columns)
        ends = ("xmin", "ymin", "xmax", "ymax") if boxed else ("x", "y", "x", "y")
        bound = [f(c).cast("double") if boxed or dotted else F.lit(None).cast("double") for f, c in zip((F.min, F.min, F.max, F.max), ends)]
        kind = "polygon" if "rings" in layer.columns else "line" if "line" in layer.columns else "point" if dotted else "table"
        row = layer.agg(F.count("*").alias("n"), *(b.alias(c) for b, c in zip(bound, ("xmin", "ymin", "xmax", "ymax"))))
        self._add(row.select(F.lit(name).alias("name"), F.lit(kind).alias("geometry_type"), "*", F.lit(", ".join(f"{c}:{t}" for c, t in layer.dtypes)).alias("columns"), F.lit(note).alias("note"), F.lit(False).alias("deleted")))

    def remove(self, name: str) -> None:
        """Forget a layer: a row that says so."""
        empty = self.spark.range(1).select(F.lit(name).alias("name"), *(F.lit(None).alias(c) for c in ("geometry_type", "n", "xmin", "ymin", "xmax", "ymax", "columns", "note")), F.lit(True).alias("deleted"))
        self._add(empty)

    def layers(self) -> DataFrame:
        """The newest description of each layer that has not been removed."""
        return self._newest(self._rows()).where("not deleted").drop("deleted", "id")

    def meta(self, name: str) -> DataFrame:
        """One row for a known layer, none for others."""
        return self.layers().where(F.col("name") == name)

    def history(self, name: str) -> DataFrame:
        return self._rows().where(F.col("name") == name).orderBy("at", "id")

    def compact(self) -> int:
        """Put the newest rows of all present folders into one and delete those folders; their number.

        Rows added meanwhile are in other folders and stay. Until the old ones are gone a
        reader sees a row twice, which changes nothing.
        """
        files = self._rows().inputFiles()
        if len(files) < 2:
            return 0
        self._newest(self.spark.read.schema(_ENTRY).parquet(*files)).coalesce(1).write.parquet(f"{self.root}/{uuid.uuid4().hex}")
        hadoop = self.spark._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in files}:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(hadoop).delete(at, True)
        return len(files)


class RunLog:
    """Rows and nulls of the steps of a run, added to a folder as each step's action ends.

    ``watch`` gives back the table with an observation on it. The first action over it
    counts as it goes; a thread that waits for the counts then adds a row, so the step is
    not run twice. ``close`` waits for these rows. A step whose action fails leaves a row
    with what was counted by then, or none.
    """

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run or uuid.uuid4().hex
        self._waiting: list[threading.Thread] = []

    def watch(self, df: DataFrame, step: str) -> DataFrame:
        seen = Observation(f"{step}-{uuid.uuid4().hex}")
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)))

        def add() -> None:
            got = seen.get
            nulls = {c: got[f"null_{i}"] for i, c in enumerate(df.columns)}
            row = self.spark.createDataFrame([(self.run, step, got["rows"], nulls)], "run string, step string, rows long, nulls map<string,long>")
            row.withColumn("at", F.current_timestamp()).write.parquet(f"{self.root}/{uuid.uuid4().hex}")

        self._waiting.append(threading.Thread(target=add, daemon=True))
        self._waiting[-1].start()
        return observed

    def close(self, seconds: float = 60.0) -> None:
        """Wait for the rows of all steps whose action has ended, ``seconds`` for each at most."""
        for t in self._waiting:
            t.join(seconds)
        self._waiting = []

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_RUN).option("recursiveFileLookup", "true").parquet(self.root).where(F.col("run") == self.run)
