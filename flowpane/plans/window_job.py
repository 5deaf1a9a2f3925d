"""Clean flows to an integrated window set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowpane.operators import windows as W
from flowpane.operators.splits import split_chrono, total_windows
from flowpane.operators.windows import WindowSpec
from flowpane.session import materialise


@dataclass
class WindowSet:
    """Positioned flows, the size of each source, and the number of windows. Everything else is derived lazily."""
    flows: DataFrame
    sizes: DataFrame
    total: int
    spec: WindowSpec

    def integrated(self, windows: DataFrame) -> DataFrame:
        """Any per-window table with global ids and the chronological 60/20/20 split."""
        return split_chrono(W.integrate(windows, self.sizes, self.spec), self.total)

    def labels(self, min_ratio: float = 0.0) -> DataFrame:
        return self.integrated(W.window_labels(self.flows, self.spec, min_ratio))

    def meta(self) -> DataFrame:
        return self.integrated(W.window_meta(self.flows, self.spec))

    def series(self, features: Sequence[str]) -> DataFrame:
        return self.integrated(W.window_series(self.flows, self.spec, features))

    def vectors(self, features: Sequence[str]) -> DataFrame:
        return self.integrated(W.window_vectors(self.flows, self.spec, features))


def build_window_set(clean: DataFrame, spec: WindowSpec, order: Sequence[str], features: Sequence[str],
                     source_order: Sequence[str] | None = None) -> WindowSet:
    """Drop the columns nobody asked for, number the rows of each source, and size the sources."""
    slim = clean.select(*dict.fromkeys([spec.source, spec.label, spec.ts, *order, *features]))
    flows = W.position_flows(slim, spec, order)
    sizes = materialise(W.source_sizes(flows, spec, source_order))
    return WindowSet(flows, sizes, total_windows(sizes), spec)
