"""Where intermediate tables go, and how they go away.

Folders stay until someone removes them, since a lazily read result may need them at any time. ``scratch`` ends the life of what was made inside it::

    with scratch(spark):
        commands.burden_tables(...)["positive"].write.csv(...)
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="burdenframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_made: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of the session.

    Without the setting, a temporary folder serves a local session; on a cluster this is an error,
    since other machines would not see it. The temporary folder goes when the driver ends.
    """
    shared = spark.conf.get(SETTING, None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
        shared = _local_folder()
    _made.append(f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the work folders made inside, at the end. Results must be written or collected by then."""
    before = len(_made)
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in _made[before:]:
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _made[before:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    Cuts the lineage: the small tables behind the tests are computed once instead of once per use,
    and a lost executor costs a re-read, not a re-run.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
