"""Least-squares problems of many groups, reduced to triangles by each task before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.storage import ship

#: Groups whose triangles a task holds before it sends them on.
HELD = 50_000


def named(k: int) -> list[str]:
    return [f"_x{j}" for j in range(k)]


def triangles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, _x0, _x1, ...): for each group and task a matrix of as many rows as columns at most that has the columns' inner products (QR).

    Over rows that have all columns; n, in a group's first row of a task, is how many there were. A group's triangles, put
    below each other, stand for all its rows.
    """
    x = named(len(columns))
    value = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan")))
    complete = df.select(*keys, *[value(c).alias(n) for c, n in zip(columns, x, strict=True)]).dropna(subset=x)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def sent() -> pd.DataFrame:
            rows = [(*key, n, *row) for key, (count, m) in held.items() for n, row in zip([count, *[0] * (len(m) - 1)], m, strict=True)]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "n", *x])

        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                m, (n, old) = part[x].to_numpy(float), held.get(key, (0, np.zeros((0, len(x)))))
                held[key] = n + len(m), np.linalg.qr(np.vstack([old, m]), mode="r")
            if len(held) > HELD:
                yield sent()
        if held:
            yield sent()

    ship(df.sparkSession)
    return complete.mapInPandas(reduce, ", ".join([*[f"`{k}` {complete.schema[k].dataType.simpleString()}" for k in keys], "n long", *[f"{c} double" for c in x]]))
