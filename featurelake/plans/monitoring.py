"""Monitoring job: drift and class-share checks over the newest predictions, with alert rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelake.functions.ordering import tail_rows
from featurelake.operators.alerts import alerts_from_drift, class_share_alert
from featurelake.operators.drift import (CLASS_1_BOUNDS, class_ratio_bounds, drift_features, drift_summary,
                                         prediction_drift, recent_summary)
from featurelake.session import cut_lineage

# Fixed value: predictions the scheduled check looks at.
JOB_WINDOW = 100


@dataclass
class MonitoringResult:
    summary: DataFrame
    features: DataFrame
    alerts: DataFrame


def monitoring_job(predictions: DataFrame, reference: DataFrame, inputs: Sequence[str], window: int = JOB_WINDOW,
                   bounds: tuple[float, float] = CLASS_1_BOUNDS, fail_on_alert: bool = False,
                   auto_retrain: bool = True, ts: str = "ts", tie: str = "prediction_id") -> MonitoringResult:
    """One summary row (window analysis, whole-log class share, decisions) plus details and alerts.

    The class share is judged on all predictions, the drift on the window. The window is bounded
    and stored once, because three results read it.
    """
    recent = cut_lineage(tail_rows(predictions, window, ts, tie))
    features = drift_features(reference, recent.select(*inputs))
    shares = class_ratio_bounds(predictions, bounds=bounds)
    share = shares.first()
    drifted = F.col("data_drift") | F.col("prediction_drift")
    alerted = drifted | F.col("out_of_bounds")
    summary = (
        recent_summary(recent, reference, inputs)
        .withColumns({
            "all_predictions": F.lit(share["total"]).cast("bigint"),
            "out_of_bounds": F.lit(bool(share["out_of_bounds"])),
        })
        .withColumns({
            "has_alert": alerted,
            "retrain": drifted & F.lit(auto_retrain),
            "exit_code": (alerted & F.lit(fail_on_alert)).cast("int"),
        })
    )
    now = F.current_timestamp()
    alerts = alerts_from_drift(drift_summary(features), prediction_drift(recent), now, features)
    if share["out_of_bounds"]:
        known = predictions.sparkSession.createDataFrame([share], shares.schema)
        alerts = alerts.unionByName(known.select(class_share_alert(now, bounds).alias("a")).select("a.*"))
    return MonitoringResult(summary, features, alerts)
