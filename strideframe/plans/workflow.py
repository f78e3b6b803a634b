"""The whole job: recordings to interim table to features to trained models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from strideframe.operators.extraction import feature_extraction
from strideframe.plans.hyperparameters import FAMILIES
from strideframe.plans.training import multipredictor
from strideframe.sources.recordings import process_recordings
from strideframe.sources.tables import read_features, write_features

# The study's participants with unlabelled locations, participants kept for testing,
# and its selection of channels and statistics.
MISSING_LOCATIONS = {2: "thigh_l", 6: "pelvis", 7: "pelvis", 16: "thigh_l"}
SKIP_PARTICIPANTS = (15, 16)
MEASURES = ("global angle", "mag", "gyro", "accel")
LOCATIONS = ("pelvis", "thigh", "shank", "foot_", "foot sensor")
DIMENSIONS = ("z",)
STATS = ("min", "max")


def extract_features(spark: SparkSession, input_path: str, output_path: str, period: int = 300) -> DataFrame:
    """Stored interim table of the full sensor set to a stored feature table, with all four statistics."""
    return write_features(feature_extraction(read_features(spark, input_path), period), output_path)


def run_workflow(
    samples: DataFrame,
    output_dir: str,
    models: Sequence[str] = FAMILIES,
    run_id: str = "run",
    missing_locations: Mapping[int, str] | None = MISSING_LOCATIONS,
    skip_participants: Sequence[int] = SKIP_PARTICIPANTS,
    window: int = 800,
    split: float = 0.8,
    measures: Sequence[str] = MEASURES,
    locations: Sequence[str] = LOCATIONS,
    dimensions: Sequence[str] = DIMENSIONS,
    stats: Sequence[str] = STATS,
    params: Mapping[str, Mapping] | None = None,
    save: bool = True,
) -> DataFrame:
    """Run records of the trained families; tables and models are written below ``output_dir``.

    The interim and the feature table are stored, so each later step starts from files.
    """
    base = output_dir.rstrip("/")
    process_recordings(
        samples,
        f"{base}/interim",
        skip_participants=skip_participants,
        missing_locations=missing_locations,
        measures=measures,
        locations=locations,
        dimensions=dimensions,
    )
    interim = read_features(samples.sparkSession, f"{base}/interim")
    features = write_features(feature_extraction(interim, window, stats, False), f"{base}/features")
    runs = None
    for family in models:
        chosen = None if params is None else params.get(family)
        run = multipredictor(
            features, f"{family}_{run_id}", family, window, split, chosen, output_dir=f"{base}/models", save=save
        )["run"]
        runs = run if runs is None else runs.unionByName(run)
    return runs
