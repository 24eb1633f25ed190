"""What column expressions cannot say: batched linear algebra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decompose(cov: DataFrame, id: str = "splat_id") -> DataFrame:
    """(id, s1 >= s2 >= s3, r00 … r22): deviations and a proper rotation of covariances cxx … czz."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = b[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy().reshape(-1, 3, 3)
            u, s, _ = np.linalg.svd(c)
            u[:, :, 2] *= np.where(np.linalg.det(u) < 0, -1.0, 1.0)[:, None]
            out = pd.DataFrame({id: b[id], **{f"s{i + 1}": np.sqrt(np.maximum(s[:, i], 0)) for i in range(3)}})
            yield out.assign(**{f"r{i}{j}": u[:, i, j] for i in range(3) for j in range(3)})

    fields = ", ".join([f"{id} {cov.schema[id].dataType.simpleString()}", *[f"s{i} double" for i in (1, 2, 3)], *[f"r{i}{j} double" for i in range(3) for j in range(3)]])
    return cov.mapInPandas(run, fields)
