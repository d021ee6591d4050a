"""Results that are kept: the folder that all machines share, and plans cut at a stored result."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete the shuffle files of an execution at its end; without it they stay until the driver's garbage goes.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it. Only a session of one machine,
    as in tests, may leave it unset, and gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    return tempfile.mkdtemp(prefix="shared-")


_LOCK = Lock()
#: For each session that is writing checkpoints: how many, and CLEAN_UP as it was before the first of them.
_WRITING: WeakKeyDictionary[SparkSession, tuple[int, str]] = WeakKeyDictionary()


@contextmanager
def _cleaning_up(session: SparkSession) -> Iterator[None]:
    """CLEAN_UP is on while any thread of the session is in here, and then what it was before."""
    with _LOCK:
        n, before = _WRITING.get(session) or (0, session.conf.get(CLEAN_UP, "false"))
        _WRITING[session] = n + 1, before
        session.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(session)
            if n > 1:
                _WRITING[session] = n - 1, before
            else:
                session.conf.set(CLEAN_UP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the session's shared folder, and releases the shuffles that led to it."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_folder(session))
    with _cleaning_up(session):
        return df.select("*").checkpoint()  # a plan takes the setting when it is made
