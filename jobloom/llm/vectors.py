"""What the operators on embeddings share: which vectors take part, and how they travel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = 2**63 - 1


def takes_part(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part; a null id becomes NULL_ID."""
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(takes_part(F.col("v")))


def pack_exact(x: np.ndarray) -> np.ndarray:
    """Rows as bytes of single floats where nothing is lost by that (as where a table holds floats), else of doubles."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    fits = (short == x).all(axis=1)
    return np.array([a.tobytes() if f else b.tobytes() for a, b, f in zip(short, np.ascontiguousarray(x, dtype="<f8"), fits, strict=True)], dtype=object)


def unpack_exact(cells, d: int) -> np.ndarray:
    """Rows of doubles from what pack_exact made of vectors of length d."""
    sizes = {len(c) for c in cells}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(cells), dtype=f"<f{sizes.pop() // d}").reshape(len(cells), d).astype(np.float64)
    return np.stack([np.frombuffer(c, dtype=f"<f{len(c) // d}").astype(np.float64) for c in cells])


def by_length(arrays) -> dict[int, list[int]]:
    """Places of the arrays of each length: only vectors of one length are compared."""
    out: dict[int, list[int]] = {}
    for i, a in enumerate(arrays):
        out.setdefault(len(a), []).append(i)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
