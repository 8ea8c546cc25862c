"""Intermediate tables in the shared folder, and scopes after which they are deleted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from wavecohort.session import cut_lineage, scratch_path

# While a table is written: shuffle files go with their job, and Python workers get texts in batches of bounded size.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written and read back, and its path; the shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.select("*").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; what made it is no longer needed then.

    Inside ``scratch`` the table lives as long as the innermost scope.
    """
    out, path = _written(df, name)
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for the result of a scope: it lives as long as the scope outside."""
    out, path = _written(df, name)
    if len(scopes := _scopes.get()) > 1:
        scopes[-2].append(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what ``stored`` has written inside.  Nothing lazy that reads it may leave the scope."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        jvm = spark.sparkContext._jvm
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
