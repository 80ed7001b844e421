"""Tables that a computation writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

_own_dirs: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, only a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own_dirs:
        own = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dirs[app] = "file://" + own
    return _own_dirs[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch_path = path
    if _scopes:
        _scopes[-1].append(found)
    return found


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` returned and that no later result reads; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path is None:
            continue
        jvm = table.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # what can't be deleted stays
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        table._scratch_path = None


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written inside are deleted at its end, but for those that were given to ``keep``, what it yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        for table in own:
            if not any(table is k for k in kept):
                dropped(table)
            elif _scopes:
                _scopes[-1].append(table)
