"""Compositions of operators that end in a stored dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.contracts import FEATURES
from tapeframe.operators.features import FeatureConfig, extract_features
from tapeframe.operators.splits import with_point_in_time_flags
from tapeframe.sources import commits, lake


def extract_and_store(
    tape: DataFrame, root: str, dataset_id: str, config: FeatureConfig = FeatureConfig(), batch: str = "features"
) -> DataFrame:
    """Features of a tape, committed under their contract as one batch, with the point-in-time audit of what is stored.

    The audit takes the receive time as availability, so a row used before it arrived is found.
    """
    commits.commit(extract_features(tape, config), root, dataset_id, batch, FEATURES, provenance={"operator": "extract_features"})
    rows = lake.contracted(lake.read_dataset(tape.sparkSession, root, dataset_id), FEATURES)
    return with_point_in_time_flags(
        rows, "event_timestamp_ns", "source_timestamp_ns", "decision_timestamp_ns"
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("is_lookahead").alias("lookahead_rows"),
        F.count_if("is_acausal").alias("acausal_rows"),
    )
