"""Vectors as rows of whole numbers floor(scale * x), packed as doubles, which hold them exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, limit: float, dim: int | None = None) -> DataFrame:
    """(row, id, dim, vec) of the usable vectors: not null, all components finite and not null, of `dim` components if that is given.

    vec holds the doubles floor(scale * x), brought to [-limit, limit]; row tells repeated rows apart once the result is checkpointed."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, dims, data = [], [], []
            for i, v in enumerate(batch.column(2)):
                if v.is_valid and v.values.null_count == 0 and (dim is None or len(v) == dim):
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                    if np.isfinite(x).all():
                        at.append(i)
                        dims.append(len(x))
                        data.append((np.clip(np.floor(scale * x), -limit, limit) + 0.0).tobytes())
            out = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(dims, pa.int32()), pa.array(data, pa.binary())], ["row", "id", "dim", "vec"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return rows.mapInArrow(run, f"row long, id {id_type}, dim int, vec binary")


def stacked(packed: list[bytes], dim: int) -> np.ndarray:
    """The rows of a matrix from packed vectors of one length."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)
