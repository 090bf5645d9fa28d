"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def worker_store(owner: str) -> dict:
    """A dictionary that a Python worker keeps until another owner asks for one.

    Functions of this package travel by value, so globals of their own modules are new in
    every task; a tokenizer or a memo kept here serves all tasks of a worker. What a stage left
    behind goes when the next one, with another owner, begins in the same worker.
    """
    name = "surveyloom_worker_store"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if held.get("owner") != owner:
        import pyarrow as pa

        held["owner"], held["objects"] = owner, {}
        gc.collect()
        pa.default_memory_pool().release_unused()
        # what small objects leave free stays with the process unless the C library is asked
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)
    return held["objects"]


def object_strings(frame):
    """The pandas frame with strings as plain objects, which Arrow always turns into one array."""
    return frame.astype({c: object for c in frame.columns if frame[c].dtype.name in ("str", "string")})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
