"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    cols: Sequence[str]
    eigenvalues: Sequence[float]  # all, descending
    loadings: Sequence[Sequence[float]]  # one list per component

    def shares(self, spark: SparkSession) -> DataFrame:
        """Eigenvalue and share of the total variance per component."""
        total = sum(self.eigenvalues)
        rows = [(i + 1, v, v / total) for i, v in enumerate(self.eigenvalues)]
        return spark.createDataFrame(rows, "component int, eigenvalue double, share double")

    def project(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Scores of the un-centred rows on the kept components."""
        out = []
        for i, line in enumerate(self.loadings):
            score = F.lit(0.0)
            for c, w in zip(self.cols, line):
                score = score + F.col(f"`{c}`") * F.lit(w)
            out.append(score.alias(f"pc{i + 1}"))
        return df.select(*keep, *out)


def pca(df: DataFrame, cols: Sequence[str], k: int = 3) -> Components:
    """Eigenpairs of the sample covariance, all eigenvalues and the first k loading vectors.

    The covariance is summed on the executors in one pass; only its len(cols) squared numbers reach
    the driver. Each loading vector is signed so that its largest entry is positive. Rows with a
    null are left out.
    """
    clean = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).dropna()
    rows = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(clean).select("_x")
    fitted = PCA(k=len(cols), inputCol="_x", outputCol="_pc").fit(rows)
    spread = clean.agg(*[F.var_samp(f"`{c}`").alias(f"v{i}") for i, c in enumerate(cols)]).first()
    total = sum(spread)
    lines = []
    for v in fitted.pc.toArray().T[:k]:
        lines.append((v * np.sign(v[np.argmax(np.abs(v))])).tolist())
    return Components(cols, [float(s) * total for s in fitted.explainedVariance.toArray()], lines)
