"""Sequence heuristics of a window, as columns: scales, fractions, entropy, runs and their weighted bonus."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A


@dataclass(frozen=True)
class BonusWeights:
    # Default results depend on them as they are.
    surface: float = 0.25
    flexibility: float = 0.20
    polar: float = 0.10
    gp: float = 0.25
    hydrophobe_penalty: float = 0.15
    complexity: float = 0.30
    transition: float = 0.20
    repeat_penalty: float = 0.40
    acidic_run_penalty: float = 0.60
    basic_run_penalty: float = 0.55
    charged_run_penalty: float = 0.90
    acidic_excess_penalty: float = 0.80


METRICS = (
    "surface", "flex", "polar", "acidic", "basic", "gp", "hydrophobe", "entropy", "transition", "repeat", "acidic_run", "basic_run", "charged_run",
)


def count_of(window: Column, letters: str) -> Column:
    return F.length(window) - F.length(F.translate(window, letters, ""))


def mean_scale(window: Column, scale: dict[str, float]) -> Column:
    by_weight: dict[float, str] = {}
    for letter, weight in scale.items():
        by_weight[weight] = by_weight.get(weight, "") + letter
    return sum((count_of(window, letters) * F.lit(w) for w, letters in by_weight.items()), F.lit(0.0)) / F.length(window)


def normalized_scale(window: Column, scale: dict[str, float]) -> Column:
    lo, hi = min(scale.values()), max(scale.values())
    return (mean_scale(window, scale) - lo) / (hi - lo)


def classes_of(window: Column) -> Column:
    """Each residue as its class: a, b, p, g or h; other letters are o."""
    groups = {"a": A.ACIDIC, "b": A.BASIC, "p": A.POLAR, "g": A.SMALL, "h": A.HYDROPHOBIC}
    known = "".join(groups.values())
    return F.translate(F.regexp_replace(window, f"[^{known}]", "_"), known + "_", "".join(k * len(v) for k, v in groups.items()) + "o")


def entropy(classes: Column, kinds: int = 5) -> Column:
    n = F.length(classes)
    terms = sum((F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in (count_of(classes, k) for k in "abpgho")), F.lit(0.0))
    return F.when(n > 1, terms / F.log2(F.least(F.lit(kinds), n).cast("double"))).otherwise(0.0)


def longest(window: Column, pattern: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(window, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))


def transitions(classes: Column) -> Column:
    """Changes of class over the places where one could be; a change starts each run but the first."""
    n = F.length(classes)
    return F.when(n > 1, (F.regexp_count(classes, F.lit(r"(.)\1*")) - 1) / (n - 1)).otherwise(0.0)


def metrics(window: Column) -> dict[str, Column]:
    n, classes = F.length(window), classes_of(window)
    return dict(
        zip(
            METRICS,
            (
                normalized_scale(window, A.SURFACE),
                normalized_scale(window, A.FLEX),
                count_of(window, A.POLAR_OR_CHARGED) / n,
                count_of(window, A.ACIDIC) / n,
                count_of(window, A.BASIC) / n,
                count_of(window, A.SMALL) / n,
                count_of(window, A.HYDROPHOBIC) / n,
                entropy(classes),
                transitions(classes),
                longest(window, r"(.)\1*") / n,
                longest(window, f"[{A.ACIDIC}]+") / n,
                longest(window, f"[{A.BASIC}]+") / n,
                longest(window, f"[{A.CHARGED}]+") / n,
            ),
        )
    )


def bonus(m: dict, weights: BonusWeights = BonusWeights(), number=F.lit, larger=F.greatest):
    """The weighted sum of metrics, which are columns, or arrays with ``number`` and ``larger`` for these."""
    w = {f.name: number(float(getattr(weights, f.name))) for f in fields(weights)}
    plus = {"surface": "surface", "flexibility": "flex", "polar": "polar", "gp": "gp", "complexity": "entropy", "transition": "transition"}
    minus = {"hydrophobe_penalty": "hydrophobe", "repeat_penalty": "repeat", "acidic_run_penalty": "acidic_run", "basic_run_penalty": "basic_run", "charged_run_penalty": "charged_run"}
    total = sum((w[k] * m[c] for k, c in plus.items()), number(0.0))
    total = total - sum((w[k] * m[c] for k, c in minus.items()), number(0.0))
    return total - w["acidic_excess_penalty"] * larger(number(0.0), m["acidic"] - 0.25)
