"""Small things that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it is unset, one machine (tests) gets a temporary
    one; a cluster is refused, as its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder in spark.checkpoint.dir and go on from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def whole_batches(pdf: pd.DataFrame, texts: pd.Series, most: int) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    """A batch in parts of about ``most`` characters, so that what is made of it leaves a part at a time; at its end, memory
    that Arrow holds and no longer uses goes back."""
    for lo, hi in spans(texts.str.len().to_numpy(), most):
        yield pdf.iloc[lo:hi], texts.iloc[lo:hi].to_list()
    pa.default_memory_pool().release_unused()


def sampled(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of ``keys``: the same rows wherever it is asked.

    Rows beyond a share of the hash's range, about twice what is wanted, are dropped where they are read, so what
    is sorted and moved is of a fixed size too, whatever the number of partitions.
    """
    place = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 40))
    share = 2 * most / max(1, df.count())
    kept = df if share >= 1 else df.where(place < int(share * (1 << 40)))
    return kept.orderBy(place, *keys).limit(most)


def spans(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs whose lengths add up to about ``most``, so that a batch of long texts stays small in memory."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
