"""The whole cleaning job as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowpane.functions import labels as L
from flowpane.functions import numbers as N
from flowpane.functions import vocabulary as V
from flowpane.operators import clean as C


@dataclass(frozen=True)
class CleanSpec:
    """How one kind of raw file becomes a clean flow table with columns ``ts``, ``label`` and numeric features."""
    ts: str = "Timestamp"
    ts_format: str | None = None
    epoch: bool = False
    half_day_cutoff: int | None = 8
    label: str = "Label"
    category: str | None = None
    aliases: Mapping[str, str] = field(default_factory=lambda: V.COLUMN_ALIASES)
    unused: Sequence[str] = tuple(V.UNUSED_COLUMNS)
    keep: Sequence[str] = ("source",)
    na_policy: str = "drop"
    tie_break: Sequence[str] = ()
    dedup: bool = True


def clean_flows(raw: DataFrame, spec: CleanSpec) -> DataFrame:
    """Names, then unused columns, time, label, numbers, missing values, duplicates."""
    df = C.harmonise_columns(raw, spec.aliases)
    if spec.category:
        label = L.label_from_category(F.col(spec.category), F.col(spec.label).try_cast("int"))
    else:
        label = L.canonical_label(F.col(spec.label))
    when = N.epoch_ts(F.col(spec.ts)) if spec.epoch else N.parse_ts(F.col(spec.ts), spec.ts_format)
    if spec.half_day_cutoff is not None:
        when = N.half_day_fixed(when, spec.half_day_cutoff)
    df = df.withColumn("_ts", when).withColumn("_label", label)
    df = C.drop_columns(df, [*spec.unused, spec.ts, spec.label, *([spec.category] if spec.category else [])])
    df = df.withColumnsRenamed({"_ts": "ts", "_label": "label"})
    features = [c for c in df.columns if c not in ("ts", "label", *spec.keep, *spec.tie_break)]
    df = C.null_nonfinite(C.coerce_numeric(df, features), features)
    df = C.apply_na_policy(df, spec.na_policy, features)
    if spec.dedup:
        df = C.dedup_flows(df, ["ts", *spec.tie_break])
    return df


def clean_headerless(raw: DataFrame, keep: Sequence[str] = ("source",)) -> DataFrame:
    """The headerless 49-column files: epoch times, category labels, coded protocol, state and service."""
    coded, _ = C.encode_categories(raw, V.HEADERLESS_CATEGORIES)
    unused = [c for c in V.HEADERLESS_UNUSED if c not in ("Stime", "label", "attack_cat")]
    return clean_flows(coded, CleanSpec(ts="Stime", epoch=True, half_day_cutoff=None, label="label",
                                        category="attack_cat", unused=unused, keep=keep, na_policy="zero"))
