"""Windows to a drift report between the training and the test part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.operators import discrepancy, drift
from flowpane.operators.window_features import rfft_amplitude
from flowpane.plans.window_job import WindowSet
from flowpane.session import materialise


def feature_drift(windows: WindowSet, features: Sequence[str]) -> DataFrame:
    """Per feature: how far test is from normal training, for all and for normal test windows, and why."""
    tall = drift.window_values(windows.series(features), ["split", "is_malicious"])
    return drift.drift_sources(drift.distribution_distances(drift.as_pairs(tall), ["pair", "feature"]))


def frequency_drift(windows: WindowSet, features: Sequence[str], digits: int = 7) -> DataFrame:
    """Per frequency bin: distances between normal training and normal test spectra, with the band means beside.

    Amplitudes are rounded to ``digits``, so that spectra which are equal but for rounding errors stay ties.
    """
    normal = rfft_amplitude(windows.series(features)).where("is_malicious = 0")
    normal = normal.withColumn("amp", F.transform("amp", lambda a: F.round(a, digits)))
    curve = materialise(drift.spectral_drift(drift.two_sides(normal, "split", "train", "test")))
    bins = windows.spec.size // 2 + 1
    band = drift.band_summary(curve, "wasserstein", bins).first()
    return curve.withColumns({f"{k}_mean": F.lit(band[k]) for k in ("overall", "low", "high")})


def shift_of(windows: WindowSet, features: Sequence[str], a: str = "train", b: str = "test", seed: int = 0) -> DataFrame:
    """The drift report of one data set: (section, rank, item, value) between two parts of its windows.

    Flows count as often as they stand in windows; kernel widths come from the mean squared distance between the parts.
    """
    long = materialise(drift.two_sides(windows.series(features), "split", a, b))
    tall = drift.window_values(long, ["side"])
    vectors = materialise(drift.counted_vectors(drift.two_sides(windows.vectors(features), "split", a, b), ["side"]))
    distances = materialise(drift.with_significance(drift.distribution_distances(tall)))
    return drift.shift_report(distances, discrepancy.mmd(vectors, seed=seed, times="n"), drift.label_shift(windows.labels(), a, b),
                              discrepancy.mmd_per_feature(tall))
