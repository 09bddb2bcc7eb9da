"""Risk levels, bands and factor expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of complexity, centrality, test, dependency, change and bus risk.
RISK_WEIGHTS = (0.25, 0.20, 0.20, 0.15, 0.10, 0.10)
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Risks of a file without history.
UNKNOWN_CHANGE, UNKNOWN_BUS = 0.3, 0.5


def complexity_risk(cyclomatic: Column, cognitive: Column) -> Column:
    return F.least((F.coalesce(cyclomatic, F.lit(0)) + F.coalesce(cognitive, F.lit(0)) / 2) / 15, F.lit(1.0))


def test_risk(n_tests: Column) -> Column:
    return F.when(n_tests == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - 0.3 * n_tests))


def dependency_risk(n_dependents: Column) -> Column:
    return F.least(n_dependents / 10, F.lit(1.0))


def degree_change_risk(degree: Column) -> Column:
    return F.least(degree / 20, F.lit(1.0))


def total_risk(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for part, weight in zip(parts, RISK_WEIGHTS, strict=True):
        total = total + part * weight
    return F.least(total, F.lit(1.0))


def risk_level(score: Column) -> Column:
    return F.when(score < 0.2, "LOW").when(score < 0.5, "MEDIUM").when(score < 0.8, "HIGH").otherwise("CRITICAL")


def degree_level(degree: Column) -> Column:
    return F.when(degree >= 8, "CRITICAL").when(degree >= 5, "HIGH").when(degree >= 2, "MEDIUM").otherwise("LOW")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")


def level_weight(level: Column) -> Column:
    """LOW 0.25, MEDIUM 0.5, HIGH 0.75, CRITICAL 1."""
    return level_rank(level) / F.lit(4)


def closure_band(affected: Column) -> Column:
    return F.when(affected > 10, "HIGH").when(affected > 5, "MODERATE").otherwise("LOW")


def top_risks(risks: dict[str, Column], least: float = 0.5) -> Column:
    """'name (n %)' of every risk of at least `least`, in the order given."""
    return F.array_compact(F.array(*[F.when(r >= least, F.concat(F.lit(name.removesuffix("_risk").replace("_", " ") + " ("), F.round(r * 100, 0).cast("int").cast("string"), F.lit(" %)"))) for name, r in risks.items()]))


def reference_level(refs: Column) -> Column:
    return F.when(refs >= 8, "high").when(refs >= 3, "medium").otherwise("low")


def complexity_band(cyclomatic: Column) -> Column:
    return F.when(cyclomatic > 10, "HIGH").when(cyclomatic > 5, "MODERATE").otherwise("LOW")


def recommendations(complexity: Column, tests: Column, n_tests: Column, centrality: Column, dependency: Column, bus: Column) -> Column:
    """Advice for every factor over its threshold; one line where none is."""
    lines = F.array_compact(
        F.array(
            F.when(complexity >= 0.7, "reduce complexity before changing this"),
            F.when((tests >= 0.7) & (n_tests == 0), "add unit tests before changing this"),
            F.when((tests >= 0.7) & (n_tests > 0), "add more tests"),
            F.when(centrality >= 0.6, "on a critical path: changes spread widely"),
            F.when(dependency >= 0.6, "many modules depend on this: tell their teams"),
            F.when(bus >= 0.7, "pair or review with a second developer"),
        )
    )
    return F.when(F.size(lines) == 0, F.array(F.lit("risk is acceptable"))).otherwise(lines)


def commit_share_risk(changes: Column, most: Column, recent_share: Column) -> Column:
    return F.least(0.6 * F.least(changes / F.greatest(most, F.lit(1)), F.lit(1.0)) + 0.4 * recent_share, F.lit(1.0))


def bus_risk(authors: Column) -> Column:
    return F.when(authors <= 1, 1.0).when(authors == 2, 0.7).when(authors == 3, 0.4).when(authors == 4, 0.2).otherwise(0.1)


def bar(share: Column, width: int = 10) -> Column:
    """A text bar of `width` places, filled by share."""
    n = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("."), F.lit(width) - n))
