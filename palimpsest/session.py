"""Session settings the operators rely on."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC times, the last of duplicate map keys wins, adaptive execution with splitting of skewed joins."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, else ``spark.checkpoint.dir``, else (in tests) a new local one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="palimpsest-"))
    return context.getCheckpointDir()


#: Tables that ``kept`` has written and nobody has removed.
_written: list[str] = []


def _place(spark: SparkSession, path: str, act) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark._jsc.hadoopConfiguration()), place)


@contextlib.contextmanager
def collected(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``kept`` writes within it; for a caller who has stored the results by then."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            _place(spark, path, lambda files, place: files.delete(place, True))
        del _written[before:]


def kept(frame: DataFrame, partitioned: bool = False) -> DataFrame:
    """``frame``, computed once and read from the shared folder from then on, also when an executor is lost.

    A written table, or with ``partitioned`` a checkpoint, which keeps how the rows are dealt. A table goes with ``collected``, or when the driver ends.
    """
    path = shared_dir(frame.sparkSession)
    if partitioned:
        return frame.checkpoint()
    path = f"{path}/palimpsest-kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written.append(path)
    _place(frame.sparkSession, path, lambda files, place: files.deleteOnExit(place))
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
