"""Places for user-supplied scorers and readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DETECTION, TEXT_REGION


def score_with(variants: DataFrame, predictor: Callable | None = None, columns: list[str] | None = None) -> DataFrame:
    """Add ``model, composition_score, predicted_performance``.

    ``predictor(pandas.DataFrame) -> pandas.Series`` runs on Arrow batches. Where
    a batch fails, its halves are tried, down to single rows: only those that
    fail by themselves keep the rule score alone, with the reason in
    ``prediction_error``. So a few bad rows cost a few calls each, not one for
    every row. Without a predictor no row has a prediction.
    """
    base = variants.withColumn("composition_score", F.col("score")).withColumn("available", F.lit(predictor is not None))
    if predictor is None:
        return base.withColumn("model", F.lit("heuristic")).withColumn("predicted_performance", F.lit(None).cast("double")).withColumn("prediction_error", F.lit(None).cast("string"))
    name = getattr(predictor, "name", getattr(predictor, "__name__", "custom"))
    cols = columns or ["score"]

    @F.pandas_udf("value double, error string")
    def run(frame):
        import pandas as pd

        values, errors = [None] * len(frame), [None] * len(frame)
        parts = [(0, len(frame))]
        while parts:
            a, b = parts.pop()
            try:
                found = pd.Series(predictor(frame.iloc[a:b]))
                if b - a == 1:
                    values[a] = float(found.iloc[0])
                elif len(found) == b - a:
                    values[a:b] = found.astype("float64")
                else:
                    raise ValueError(f"{len(found)} values for {b - a} rows")
            except Exception as e:  # noqa: BLE001 - a scorer must not stop the batch
                if b - a > 1:
                    parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
                elif b > a:
                    errors[a] = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"value": pd.Series(values, dtype="float64"), "error": pd.Series(errors, dtype="object")})

    return base.withColumn("model", F.lit(name)).withColumn("_p", run(F.struct(*cols))).select(
        "*", F.col("_p.value").alias("predicted_performance"), F.col("_p.error").alias("prediction_error")).drop("_p")


def detect_with(images: DataFrame, detector: Callable) -> DataFrame:
    """Detections of a user-supplied function over batches of images."""
    return images.mapInPandas(lambda it: (detector(b) for b in it), DETECTION)


def read_text_with(images: DataFrame, reader: Callable) -> DataFrame:
    """Text regions of a user-supplied function over batches of images."""
    return images.mapInPandas(lambda it: (reader(b) for b in it), TEXT_REGION)
