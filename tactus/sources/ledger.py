"""Tables that grow by whole commits.

Each run writes a directory of its own and becomes visible by one small log entry, whose file is created only if
its number is free. What a killed run leaves behind is in no entry and is never read; of two runs at
a time the second finds its number taken, leaves out what the first has added and tries the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG, DATA = "_log", "data"


class _Files:
    """The file system of a path, through Spark's own configuration."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file unless there is one; it is never seen half written."""
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(name)
        try:
            if self._fs.exists(target):
                return False
            # create() without overwriting claims the name; the draft then takes its place.
            self._fs.create(target, False).close()
        except Exception as fault:
            if "AlreadyExists" in str(fault):
                return False
            raise
        finally:
            if not self._fs.exists(target):
                self._fs.delete(draft, False)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), options)
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def commits(spark: SparkSession, path: str) -> list[str]:
    """Directories of the runs that are done, oldest first."""
    files = _Files(spark, path)
    done = [n for n in files.names(LOG) if n.endswith(".entry")]
    return [f"{files.root}/{DATA}/{run}" for n in done if (run := files.read(f"{LOG}/{n}").strip())]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows, or None before the first commit. Files that cannot be read count as not there."""
    found = commits(spark, path)
    if not found:
        return None
    return spark.read.option("ignoreCorruptFiles", "true").option("basePath", f"{path.rstrip('/')}/{DATA}").parquet(*found).drop("run")


def add(df: DataFrame, path: str, key: str, partition_by: list[str], before_commit: Callable[[], None] = lambda: None) -> int:
    """Commit the rows whose ``key`` is not there yet; how often it took a new number to do so.

    ``before_commit`` is called between writing and committing.
    """
    spark = df.sparkSession
    files = _Files(spark, path)
    number = len([n for n in files.names(LOG) if n.endswith(".entry")])
    there = read(spark, path)
    if there is not None:
        df = df.join(there.select(key).distinct(), key, "left_anti")
    run = f"run={uuid.uuid4().hex}"
    df.repartition(*partition_by).write.partitionBy(*partition_by).parquet(f"{files.root}/{DATA}/{run}")
    before_commit()
    tries = 0
    while not files.create(f"{LOG}/{number:012d}.entry", run):
        # Another run was first. Its keys go from this one's rows, which are written anew.
        tries += 1
        number += 1
        mine = spark.read.option("basePath", f"{files.root}/{DATA}/{run}").parquet(f"{files.root}/{DATA}/{run}")
        rest = mine.join(read(spark, path).select(key).distinct(), key, "left_anti").select(*df.columns)
        late = f"run={uuid.uuid4().hex}"
        rest.repartition(*partition_by).write.partitionBy(*partition_by).parquet(f"{files.root}/{DATA}/{late}")
        files.delete(f"{DATA}/{run}")
        run = late
    return tries


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete what runs that never committed have left; only while none is at work. Returns their names."""
    files = _Files(spark, path)
    done = {p.rsplit("/", 1)[1] for p in commits(spark, path)}
    left = [n for n in files.names(DATA) if n not in done]
    for name in left:
        files.delete(f"{DATA}/{name}")
    for name in files.names(LOG):
        if name.endswith(".draft"):
            files.delete(f"{LOG}/{name}")
    return left
