"""Binned series: shifts, spectra, covariances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shifted(series: DataFrame, shift: Column, n_bins: int, circular: bool) -> DataFrame:
    """Bins moved by ``shift``: round the ends, or out of the window (absent bins are 0)."""
    b = F.col("bin") + shift
    if circular:
        return series.withColumn("bin", F.pmod(b, F.lit(n_bins)))
    return series.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < n_bins))


def _segments(series: DataFrame, keys: tuple[str, ...], n_bins: int, length: int, step: int) -> DataFrame:
    """Each row once for every segment that holds its bin; segments start at multiples of ``step`` and end in time."""
    last = max(0, (n_bins - length) // step)
    first = F.greatest(F.lit(0), F.ceil((F.col("bin") - length + 1) / step))
    holds = F.sequence(first.cast("long"), F.least(F.lit(last), F.floor(F.col("bin") / step)).cast("long"))
    in_reach = F.col("bin") < last * step + length
    return series.where(in_reach).withColumn("segment", F.explode(holds)).select(*keys, "segment", (F.col("bin") - F.col("segment") * step).cast("int").alias("at"), "y")


def _power(keys: tuple[str, ...], length: int, nfft: int, window: np.ndarray, fs: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(length)
        y[pdf["at"]] = pdf["y"]
        spectrum = np.abs(np.fft.rfft((y - y.mean()) * window, nfft)) ** 2 / (fs * (window**2).sum())
        spectrum[1 : -1 if nfft % 2 == 0 else None] *= 2
        out = pd.DataFrame({"k": np.arange(len(spectrum)), "frequency": np.arange(len(spectrum)) * fs / nfft, "power": spectrum})
        for c in (*keys, "segment"):
            out[c] = pdf[c].iloc[0]
        return out

    return run


def spectrogram(series: DataFrame, keys: tuple[str, ...], n_bins: int, fs: float, length: int = 250, overlap: int = 245, nfft: int = 2000, tukey: float = 0.25) -> DataFrame:
    """(keys, segment, k, frequency, power) of every segment: mean removed, Tukey window, density, one side."""
    i, edge = np.arange(length), tukey * length / 2
    ramp = lambda d: 0.5 * (1 - np.cos(np.pi * np.minimum(d, edge) / max(edge, 1e-9)))
    window = ramp(i) * ramp(length - i)
    return _spectra(series, keys, n_bins, fs, length, length - overlap, nfft, window)


def welch(series: DataFrame, keys: tuple[str, ...], n_bins: int, fs: float, length: int = 1024) -> DataFrame:
    """(keys, k, frequency, power): mean over half-overlapping segments, Hann window, mean removed, density."""
    length = min(length, n_bins)
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(length) / length))
    parts = _spectra(series, keys, n_bins, fs, length, length - length // 2, length, window)
    return parts.groupBy(*keys, "k", "frequency").agg(F.avg("power").alias("power"))


def _spectra(series: DataFrame, keys: tuple[str, ...], n_bins: int, fs: float, length: int, step: int, nfft: int, window: np.ndarray) -> DataFrame:
    kinds = dict(series.dtypes)
    fields = ", ".join(["k int, frequency double, power double", *[f"{c} {kinds[c]}" for c in keys], "segment long"])
    return _segments(series, keys, n_bins, length, step).groupBy(*keys, "segment").applyInPandas(_power(keys, length, nfft, window, fs), fields)


def covariance(vectors: DataFrame, value: str = "embedding") -> DataFrame:
    """(i, j, cov): the covariance of array elements, i <= j, over the rows that have both.

    A task sums the products of its rows, so what is shuffled is one row a task and pair of elements. Null arrays take
    no part.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}  # by length: rows, sums, sums of products
        for pdf in batches:
            for n, group in pdf.groupby(pdf["v"].map(len))["v"]:
                m = np.stack(group.to_list()).astype(float)
                old = sums.get(n, [0, np.zeros(n), np.zeros((n, n))])
                sums[n] = [old[0] + len(m), old[1] + m.sum(axis=0), old[2] + m.T @ m]
        for n, (rows, one, two) in sums.items():
            i, j = np.triu_indices(n)
            yield pd.DataFrame({"i": i, "j": j, "n": rows, "x": one[i], "y": one[j], "xy": two[i, j]})

    rows = vectors.select(F.col(value).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    parts = rows.mapInPandas(run, "i int, j int, n long, x double, y double, xy double")
    n, x, y, xy = (F.sum(c) for c in ("n", "x", "y", "xy"))
    return parts.groupBy("i", "j").agg((xy / n - x / n * (y / n)).alias("cov"))


def correlations(cov: DataFrame) -> DataFrame:
    """(i, j, r) for i < j."""
    d = cov.where("i = j").select("i", F.sqrt("cov").alias("sd"))
    return (
        cov.where("i < j").join(d.withColumnRenamed("sd", "si"), "i")
        .join(d.select(F.col("i").alias("j"), F.col("sd").alias("sj")), "j")
        .where("si * sj > 0").select("i", "j", (F.col("cov") / (F.col("si") * F.col("sj"))).alias("r"))
    )


def partial_correlations(cov: DataFrame) -> DataFrame:
    """(i, j, r) of the whole matrix from its inverse; -1 on the diagonal. The matrix has as many rows as an array has
    elements, whatever the number of arrays."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["i"].max(), pdf["j"].max())) + 1
        m = np.zeros((n, n))
        m[pdf["i"], pdf["j"]] = m[pdf["j"], pdf["i"]] = pdf["cov"]
        inv = np.linalg.pinv(m)
        d = np.sqrt(np.abs(np.diag(inv)))
        i, j = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({"i": i, "j": j, "r": (-inv / np.outer(d, d)).ravel()})

    return cov.groupBy(F.lit(0).alias("g")).applyInPandas(run, "i int, j int, r double")
