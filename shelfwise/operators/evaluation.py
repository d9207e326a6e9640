"""Error of predictions on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(predictions: DataFrame, actual: str = "rating", predicted: str = "prediction") -> DataFrame:
    """One row ``(n, mae, rmse)`` over rows with a usable prediction; the errors are NULL when there is none."""
    error = F.col(predicted).cast("double") - F.col(actual)
    valid = predictions.where(F.col(predicted).isNotNull() & ~F.isnan(predicted))
    return valid.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )
