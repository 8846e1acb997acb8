"""Bootstrap and permutation in one pass over the rows: the draws of all replicates come from each row's hash, and only sums by replicate are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = (1 << 31) - 1  # a prime
#: The Poisson distribution of mean 1, summed up to four.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634)
ROWS_AT_ONCE = 4096


def coefficients(replicates: int) -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(1, replicates + 1, dtype=np.int64)
    return (1103515245 * (b + 1) + 12345) % (P - 1) + 1, (22695477 * (b + 1) + 1) % P


def uniforms(h: np.ndarray, replicates: int) -> np.ndarray:
    """A number in [0, 1) for each row and replicate, from the row's hash by a universal family."""
    a, c = coefficients(replicates)
    return ((h % P)[:, None] * a[None, :] + c[None, :]) % P / float(P)


def poisson_weights(u: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON, u, side="right").astype(np.float64)


def signs(u: np.ndarray) -> np.ndarray:
    return np.where(u < 0.5, 1.0, -1.0)


def replicate_sums(df: DataFrame, values: list[str], by: list[str] | None = None, replicates: int = 200, draw=poisson_weights) -> DataFrame:
    """(*by, b, w, s_<value>...): for each replicate the sum of the draws and of draw times value, over df with a bigint column h.

    `draw` turns uniforms into weights or signs. Each task holds sums for every replicate and value of `by`, which should be few; nulls count as 0.
    """
    by = by or []
    fields = [df.schema[c] for c in by]
    out = T.StructType([*fields, T.StructField("b", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("w", *(f"s_{v}" for v in values)))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.column_stack([np.ones(len(g)), *(g[v].fillna(0).to_numpy(np.float64) for v in values)])
                h = g["h"].to_numpy(np.int64)
                for at in range(0, len(g), ROWS_AT_ONCE):
                    part = draw(uniforms(h[at : at + ROWS_AT_ONCE], replicates)).T @ x[at : at + ROWS_AT_ONCE]
                    held[key] = held[key] + part if key in held else part
        for key, sums in held.items():
            rows = pd.DataFrame(sums, columns=[f.name for f in out.fields[len(by) + 1 :]])
            for name, v in zip(by, key, strict=True):
                rows[name] = pd.Series([None if v is None or v != v else v] * len(rows), dtype=object)
            rows["b"] = np.arange(1, replicates + 1)
            yield rows[[f.name for f in out.fields]]

    part = df.select(*by, "h", *values).mapInPandas(run, out)
    return part.groupBy(*by, "b").agg(*[F.sum(f.name).alias(f.name) for f in out.fields[len(by) + 1 :]])
