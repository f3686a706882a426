"""Places where a user's own code enters: statistics, detectors, image operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTIONS = "image_id long, category_id int, score double, x1 double, y1 double, x2 double, y2 double"


def detect(images: DataFrame, make: Callable[[], Callable[..., pd.DataFrame]], conf: float = 0.0, max_det: int = 300, iou: float | None = None) -> DataFrame:
    """Batch scoring: ``make`` builds the model once a task; it maps a frame of images to a frame of boxes with their image ids.
    With ``iou`` the model is called with conf, iou and max_det, for its own suppression."""
    told = {} if iou is None else {"conf": conf, "iou": iou, "max_det": max_det}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for b in batches:
            out = predict(b, **told)
            if not set(out["image_id"]) <= set(b["image_id"]):
                raise ValueError("the detector returned an unknown image")
            out = out[out["score"] >= conf].sort_values(["image_id", "score"], ascending=[True, False], kind="stable")
            yield out.groupby("image_id").head(max_det)[[c.split()[0] for c in DETECTIONS.split(", ")]]

    return images.mapInPandas(run, DETECTIONS)


def detect_checked(images: DataFrame, make: Callable[[], Callable[..., pd.DataFrame]], classes: list[int], **options) -> DataFrame:
    """``detect`` written once and held against the rules for detections (``validate_detections``): a row that breaks one is an
    error.  An image without boxes is none.  ``images`` has width and height."""
    from ..operators.validate import validate_detections
    from ..sources.shared import written

    found = written(detect(images, make, **options), "detected")
    numbered = found.withColumn("det_id", F.monotonically_increasing_id())
    wrong = validate_detections(numbered, images, classes).where("problem <> 'missing_image'").limit(1).collect()
    if wrong:
        raise ValueError(f"the detector's output is not valid: {wrong[0]['problem']} in image {wrong[0]['image_id']}")
    return found
