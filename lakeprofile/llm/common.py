"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.session import ensure_checkpoint_dir

CHUNK_CHARS = 1 << 18  # characters that a task works on at once


def settle() -> None:
    """Hands memory that is free again back to the machine; an executor's Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without this call keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of consecutive texts with about ``limit`` characters; a longer text makes a run of its own.

    Behind the last run, so once per batch, free memory goes back to the machine.
    """
    run, held = [], 0
    for text in texts:
        text = text or ""
        if run and held + len(text) > limit:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run
        run = []
    settle()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet and read again: the plan ends here.

    Every use of the result reads the same rows, whatever the number of cores was when they were made, and a lost
    executor costs nothing that is not in the shared folder.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder of this session."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def light(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many (narrow) rows; the other side then stays where it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
