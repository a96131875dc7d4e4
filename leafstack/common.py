"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextvars
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that an operator may broadcast by hint.
BROADCAST_LIMIT_BYTES = 16 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder that intermediate tables of the current stage go to; None is the shared folder itself.
_FOLDER: contextvars.ContextVar[str | None] = contextvars.ContextVar("leafstack-folder", default=None)
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``. A local session without it gets one of its own, which goes at exit."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="leafstack-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        path = _LOCAL[0]
    return path.rstrip("/")


class Scratch:
    """A folder for the intermediate tables written while it is entered; :meth:`remove` deletes it with all of them.

    Frames that read them can't be used afterwards, so the owner removes it when results are stored.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{_FOLDER.get() or shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._local = threading.local()  # threads that share the folder enter and leave it on their own

    def __enter__(self) -> Scratch:
        self._local.tokens = [*getattr(self._local, "tokens", []), _FOLDER.set(self.path)]
        return self

    def __exit__(self, *error) -> None:
        _FOLDER.reset(self._local.tokens.pop())

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The result survives the loss of any executor, and later branches read columns of it selectively. Tables stay until the
    :class:`Scratch` they were written in is removed.
    """
    spark = df.sparkSession
    path = f"{_FOLDER.get() or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(*tasks: Callable[[], object]) -> list:
    """Results of independent tasks that each run jobs, run side by side so that small jobs fill the cluster together."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(contextvars.copy_context().run, t) for t in tasks]]


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the optimizer's size estimate proves ``df`` to be within ``limit`` bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is within ``limit``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if small(df, limit) else df
