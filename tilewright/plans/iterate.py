"""A fixpoint loop over DataFrames that cuts the lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session, ``spark.checkpoint.dir``; on local masters only, a temporary one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tilewright.steps", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tilewright-")
        spark.conf.set("tilewright.steps", root)
    return root.rstrip("/")


#: The folder of the innermost :func:`steps` around a call; each thread has its own.
_owner: ContextVar[str | None] = ContextVar("steps", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder(spark: SparkSession) -> str:
    """Where operators write now: the folder of the innermost :func:`steps`, or the shared one."""
    return _owner.get() or scratch(spark)


@contextmanager
def steps(spark: SparkSession) -> Iterator[str]:
    """All that operators write inside the block goes to one folder, which is deleted at its end.

    Results are lazy and read these files, so use them up (write or collect) inside the block.  Blocks of other threads have folders of
    their own.
    """
    mine = f"{scratch(spark)}/steps-{uuid.uuid4().hex}"
    token = _owner.set(mine)
    try:
        yield mine
    finally:
        _owner.reset(token)
        _delete(spark, mine)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame below the shared folder (of the owner, if there is one) and read it again, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.step = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`written` that nothing reads any more."""
    known = getattr(df, "step", None) if "step" not in df.columns else None
    for parent in [known] if isinstance(known, str) else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str = "changed") -> DataFrame:
    """Apply ``step`` until no row has ``changed`` set; the column is dropped from the result.

    Every round's rows are written once and those of the round before are deleted; only one Boolean comes to the driver.
    """
    before = None
    while True:
        new = written(step(state))
        if before is not None:
            discard(before)
        if not new.where(changed).limit(1).count():
            return new.drop(changed)
        before, state = new, new.drop(changed)
