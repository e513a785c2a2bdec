"""Predicted actions to scoring form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.frames import frame_of_prediction


def filter_predictions(preds: DataFrame) -> DataFrame:
    """Valid predictions as ``frame, type, detail``; the other columns stay.

    Input ``frame, type, details`` and, if present, ``detail``. A scroll without a valid
    direction stays, with empty detail, and so counts as a false positive.
    """
    given = F.coalesce("details", "detail") if "detail" in preds.columns else F.col("details")
    text = F.regexp_replace(F.coalesce(given, F.lit("")), r"^\s+|\s+$", "")
    direction = F.lower(text)
    detail = (
        F.when(F.col("type") == "MouseScroll", F.when(direction.isin("up", "down"), direction).otherwise(""))
        .when(F.col("type") == "KeyPress", names.normalize_pred_key(text))
        .otherwise(text)
    )
    scored = preds.where(F.col("type").isin(*names.ACTION_TYPES)).withColumns(
        {"detail": detail, "frame": frame_of_prediction(F.col("frame"))}
    )
    return scored.where(F.col("frame") >= 0).drop("details")
