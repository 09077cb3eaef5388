"""Tables that an iteration writes between its rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, which only a local master shares."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="corpusflow-rounds-")
    return _own_dir[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Rounds:
    """Owns what the rounds of an iteration write. A round reads tables only, so plans don't grow with the rounds, and a lost executor costs tasks.

    Tables go when they are dropped or when the iteration ends; ``result`` gives one that outlives it and goes with the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in self.held.values()])

    def _written(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        table, path = self._written(df)
        self.held[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if held := self.held.pop(id(table), None):
                _delete(self.spark, held[1])

    def result(self, df: DataFrame) -> DataFrame:
        table, path = self._written(df)
        atexit.register(_forget, self.spark, path)
        return table


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the driver's JVM may be gone; the folder's owner clears it then
        pass
