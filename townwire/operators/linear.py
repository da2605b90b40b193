"""The linear scorer for texts that the rules leave undecided."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO_CAP = 3


@dataclass(frozen=True)
class LinearModel:
    weights: dict[str, float]
    threshold: float = 0.0
    version: str = "unknown"

    @staticmethod
    def load(path: str | Path) -> LinearModel:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        return LinearModel({k: float(v) for k, v in raw.get("weights", {}).items()}, float(raw.get("threshold", 0.0)), str(raw.get("version", "unknown")))

    def score(self, features: dict[str, Column]) -> Column:
        """Weights times features, the bias once; features without a weight count nothing."""
        terms = [c * F.lit(self.weights[name]) for name, c in features.items() if self.weights.get(name)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.weights.get("bias", 0.0)))


def features(*, micro: Column, place: Column, event: Column, venue: Column, context: Column, own_term: Column, prior: Column) -> dict[str, Column]:
    """Named doubles from the cascade's signals: flags, and the number of micro-localities up to a cap."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.least(F.size(micro), F.lit(MICRO_CAP)).cast("double")
    return {
        "micro_count": n, "has_micro": flag(n > 0), "has_place": flag(place), "event_cue": flag(event), "venue": flag(venue), "context": flag(context),
        "own_term": flag(own_term), "prior": flag(prior), "event_and_micro": flag(event & (n > 0)), "event_and_venue": flag(event & venue),
        "venue_without_cue": flag(venue & ~event), "no_place": flag(~place),
    }


def score_rows(rows: DataFrame, weights: DataFrame, key: str, bias: float = 0.0) -> DataFrame:
    """Sparse scoring: rows (key, feature, value) joined with weights (feature, weight), summed per key."""
    joined = rows.join(weights, "feature", "left")
    return joined.groupBy(key).agg((F.lit(bias) + F.sum(F.coalesce(F.col("value") * F.col("weight"), F.lit(0.0)))).alias("score"))
