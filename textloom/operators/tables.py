"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that materialize() has written since the innermost scratch() began.
_written: list[set[str]] = []
#: Names of all folders that this process has written; nothing else is ever deleted.
_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one (tests) gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = have.get() if have.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives the loss of executors."""
    name = f"textloom-{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    _made.add(name)
    df.write.parquet(path)
    if _written:
        _written[-1].add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    for paths in _written:
        paths.discard(path)


def drop_tables(df: DataFrame) -> None:
    """Deletes the written table behind df, if materialize() made it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1] in _made:
            _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written inside when it ends, but for those passed to the function it gives."""
    _written.append(set())
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        stay = {f"/{f.rsplit('/', 2)[-2]}" for df in kept for f in df.inputFiles()}
        for path in list(_written[-1]):
            if not path.endswith(tuple(stay)):
                _delete(spark, path)
        over = _written.pop()
        if _written:
            _written[-1] |= over
