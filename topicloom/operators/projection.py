"""Principal components, and the rules by which plots reduce vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType


def reduce_dimensions(df: DataFrame, vec_col: str, k: int, name: str = "reduced") -> DataFrame:
    """``df`` with its vectors projected on ``k`` centred components, signs fixed.

    The vectors are read twice before the projection: give it a written table. Signs follow
    the largest loading; components beyond n - 1 are zero.
    """
    if isinstance(df.schema[vec_col].dataType, ArrayType):
        data = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    else:
        data = df.withColumn("_v", F.col(vec_col))
    first = data.select("_v").limit(k + 1).collect()
    width = first[0][0].size if first else 0
    effective = max(0, min(k, len(first) - 1, width))
    if effective == 0:
        return df.withColumn(name, F.array_repeat(F.lit(0.0), k))
    model = PCA(k=effective, inputCol="_v", outputCol="_p").fit(data.select("_v"))
    loadings = model.pc.toArray()
    top = abs(loadings).argmax(axis=0)
    signs = [1.0 if loadings[top[i], i] >= 0 else -1.0 for i in range(effective)]
    projected = model.transform(data).withColumn("_p", vector_to_array("_p"))
    # The model projects without centring; centring afterwards keeps sparse input sparse.
    means = projected.agg(*[F.avg(F.col("_p")[i]) for i in range(effective)]).first()
    axes = [(F.col("_p")[i] - F.lit(means[i])) * F.lit(signs[i]) for i in range(effective)]
    axes += [F.lit(0.0)] * (k - effective)
    return projected.withColumn(name, F.array(*axes)).drop("_v", "_p")


def reduction_params(n: Column, components: Column) -> list[Column]:
    """Method, components, neighbours and spacing of a layout for ``n`` rows."""
    small = n < components + 1
    return [
        F.when(small, "pca").otherwise("neighbors").alias("method"),
        F.when(small, F.least(components, n - 1)).otherwise(components).cast("int").alias("k"),
        F.when(~small, neighbor_count(n)).alias("n_neighbors"),
        F.when(~small, F.when(n > 50, 0.1).otherwise(0.01)).alias("min_dist"),
    ]


def neighbor_count(n: Column) -> Column:
    return F.least(F.lit(15), F.greatest(F.lit(2), F.floor(n / 3))).cast("int")
