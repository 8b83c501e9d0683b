"""Placing samples of a stream: stateless, as loadings and factor coordinates are frozen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import linalg
from ..model import Embedding, Factorization
from ..operators.embed import pulled


def project_stream(samples: DataFrame, f: Factorization, emb: Embedding, alpha_exp: float = 1.0, n_pull: int | None = None) -> DataFrame:
    """(sample_id, h, x, y) of a (streaming) frame of whole samples: sample_id, features array, vals array. Features that
    the factorisation doesn't know are left out. Loadings (features x k, bounded as in a fit) travel with the task."""
    rows = f.w.collect()
    at = {r.feature_id: i for i, r in enumerate(rows)}
    w = np.array([r.w for r in rows])
    gram = w.T @ w
    kind = dict(samples.dtypes)["sample_id"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rhs = np.zeros((b.num_rows, w.shape[1]))
            for i, (fs, vs) in enumerate(zip(b.column("features").to_pylist(), b.column("vals").to_pylist())):
                for name, v in zip(fs or [], vs or []):
                    if name in at:
                        rhs[i] += v * w[at[name]]
            h = linalg.nnls(gram, rhs)
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32()), pa.array(h.reshape(-1)))], names=["sample_id", "h"])

    scored = samples.select("sample_id", "features", "vals").mapInArrow(run, f"sample_id {kind}, h array<double>")
    return pulled(scored.select(F.struct("sample_id", "h").alias("id"), "h"), emb.factors, "id", "h", alpha_exp, n_pull).select("id.sample_id", "id.h", "x", "y")
