"""Policies: the numbers a caller may change. Each field states its domain, one check serves all."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from math import ceil, inf, isfinite
from typing import Any

# The defaults that results must agree on.
FEATURES = {"ema_span": 9, "opening_range_minutes": 5, "volatility_window": 5, "rvol_window": 5}
UNIVERSE = {
    "target": 200,
    "cash_usd": 100.0,
    "max_spread_pct": 0.02,
    "min_coverage_ratio": 0.90,
    "max_sector_fraction": 0.25,
    "ipo_seasoning_sessions": 20,
}
COHORT = {"target": 30, "core": 20, "boundary": 5, "diversity": 5}
STRATEGY = {
    "max_spread_pct": 0.01,
    "max_volatility": 0.05,
    "min_rvol": 1.0,
    "min_volume": 1000,
    "entry_buffer_pct": 0.001,
    "stop_buffer_pct": 0.001,
    "reward_to_risk": 2.0,
    "extended_score_share": 0.20,
    "max_risk_usd": 1.0,
}
RISK = {
    "max_spread_pct": 0.01,
    "max_volatility": 0.08,
    "min_volume": 100_000,
    "min_rvol": 1.0,
    "max_risk_usd": 1.0,
    "reward_risk": 2.0,
    "setup_minutes": 30,
}
WEIGHTS = {"technical": 0.50, "market": 0.20, "news": 0.20, "social": 0.05, "fundamentals": 0.05}
FINALISTS = {"minimum": 1, "maximum": 5, "minimum_rank_score": 0.50}
EXTENDED = {
    "min_pre_active_minutes": 1,
    "min_pre_dollar_volume": 0.0,
    "max_pre_abs_return": 0.05,
    "max_pre_abs_gap": 0.05,
    "max_pre_range": 0.10,
    "max_pre_volatility": 0.05,
    "min_post_active_minutes": 1,
    "min_post_dollar_volume": 0.0,
    "max_post_abs_return": 0.05,
    "max_post_range": 0.10,
    "max_post_volatility": 0.05,
}
EXECUTION = {
    "commission_per_order": 0.0,
    "slippage_bps": 0.0,
    "manual_latency_seconds": 0.0,
    "fx_rate": None,
    "fx_fee_bps": 0.0,
    "fill_ratio": 1.0,
}
MODEL = {"train": 30, "validation": 10, "holdout": 10}
# End of the fixed values.


@dataclass(frozen=True)
class Domain:
    """Finite numbers from `low` to `high`; `open` ends are not part of it, `optional` allows None."""

    low: float = -inf
    high: float = inf
    open: str = ""
    optional: bool = False

    def holds(self, value: float | None) -> bool:
        if value is None:
            return self.optional
        above = value > self.low if "low" in self.open else value >= self.low
        below = value < self.high if "high" in self.open else value <= self.high
        return isfinite(value) and above and below

    def __str__(self) -> str:
        left, right = "(" if "low" in self.open else "[", ")" if "high" in self.open else "]"
        return f"{left}{self.low:g}, {self.high:g}{right}" + (" or None" if self.optional else "")


POSITIVE = Domain(low=0, open="low")
NATURAL = Domain(low=0)
COUNT = Domain(low=1)
SHARE = Domain(low=0, high=1)
ANY = Domain()


def number(default: Any, domain: Domain) -> Any:
    return field(default=default, metadata={"domain": domain})


class Checked:
    """Raises `ValueError` naming every field that lies outside its domain."""

    def __post_init__(self) -> None:
        found = [
            f"{each.name}={getattr(self, each.name)!r} not in {each.metadata['domain']}"
            for each in fields(self)
            if not each.metadata["domain"].holds(getattr(self, each.name))
        ]
        found = found or self.conflicts()
        if found:
            raise ValueError(f"{type(self).__name__}: {'; '.join(found)}")

    def conflicts(self) -> list[str]:
        """Relations between fields that do not hold."""
        return []


@dataclass(frozen=True)
class FeatureWindows(Checked):
    ema_span: int = number(FEATURES["ema_span"], COUNT)
    opening_range_minutes: int = number(FEATURES["opening_range_minutes"], COUNT)
    volatility_window: int = number(FEATURES["volatility_window"], Domain(low=2))
    rvol_window: int = number(FEATURES["rvol_window"], COUNT)


@dataclass(frozen=True)
class UniversePolicy(Checked):
    target: int = number(UNIVERSE["target"], COUNT)
    cash_usd: float = number(UNIVERSE["cash_usd"], POSITIVE)
    max_spread_pct: float = number(UNIVERSE["max_spread_pct"], ANY)
    min_coverage_ratio: float = number(UNIVERSE["min_coverage_ratio"], ANY)
    max_sector_fraction: float = number(UNIVERSE["max_sector_fraction"], Domain(0, 1, "low"))
    ipo_seasoning_sessions: int = number(UNIVERSE["ipo_seasoning_sessions"], ANY)

    @property
    def sector_limit(self) -> int:
        return max(1, ceil(self.target * self.max_sector_fraction))


@dataclass(frozen=True)
class CohortPolicy(Checked):
    target: int = number(COHORT["target"], NATURAL)
    core: int = number(COHORT["core"], NATURAL)
    boundary: int = number(COHORT["boundary"], NATURAL)
    diversity: int = number(COHORT["diversity"], NATURAL)

    def conflicts(self) -> list[str]:
        parts = self.core + self.boundary + self.diversity
        return [] if parts == self.target else [f"parts make {parts}, target is {self.target}"]


@dataclass(frozen=True)
class StrategyPolicy(Checked):
    max_spread_pct: float = number(STRATEGY["max_spread_pct"], NATURAL)
    max_volatility: float = number(STRATEGY["max_volatility"], NATURAL)
    min_rvol: float = number(STRATEGY["min_rvol"], NATURAL)
    min_volume: float = number(STRATEGY["min_volume"], NATURAL)
    entry_buffer_pct: float = number(STRATEGY["entry_buffer_pct"], NATURAL)
    stop_buffer_pct: float = number(STRATEGY["stop_buffer_pct"], NATURAL)
    reward_to_risk: float = number(STRATEGY["reward_to_risk"], POSITIVE)
    extended_score_share: float = number(STRATEGY["extended_score_share"], SHARE)
    max_risk_usd: float = number(STRATEGY["max_risk_usd"], POSITIVE)


@dataclass(frozen=True)
class RiskPolicy(Checked):
    max_spread_pct: float = number(RISK["max_spread_pct"], NATURAL)
    max_volatility: float = number(RISK["max_volatility"], NATURAL)
    min_volume: float = number(RISK["min_volume"], NATURAL)
    min_rvol: float = number(RISK["min_rvol"], NATURAL)
    max_risk_usd: float = number(RISK["max_risk_usd"], POSITIVE)
    reward_risk: float = number(RISK["reward_risk"], POSITIVE)
    setup_minutes: int = number(RISK["setup_minutes"], POSITIVE)


@dataclass(frozen=True)
class RankingWeights(Checked):
    technical: float = number(WEIGHTS["technical"], NATURAL)
    market: float = number(WEIGHTS["market"], NATURAL)
    news: float = number(WEIGHTS["news"], NATURAL)
    social: float = number(WEIGHTS["social"], NATURAL)
    fundamentals: float = number(WEIGHTS["fundamentals"], NATURAL)

    def conflicts(self) -> list[str]:
        total = sum(self.as_dict().values())
        return [] if abs(total - 1) <= 1e-9 else [f"total {total!r} is not 1"]

    def as_dict(self) -> dict[str, float]:
        return {each.name: float(getattr(self, each.name)) for each in fields(self)}

    def without(self, name: str) -> RankingWeights:
        """Move one optional weight to the technical component."""
        values = self.as_dict()
        values["technical"] += values[name]
        values[name] = 0.0
        return RankingWeights(**values)

    def only(self, names: tuple[str, ...]) -> RankingWeights:
        """Keep some components and renormalise them to 1."""
        values = self.as_dict()
        total = sum(values[name] for name in names)
        return RankingWeights(
            **{key: (value / total if key in names else 0.0) for key, value in values.items()}
        )


@dataclass(frozen=True)
class FinalistPolicy(Checked):
    minimum: int = number(FINALISTS["minimum"], Domain(1, 5))
    maximum: int = number(FINALISTS["maximum"], Domain(1, 5))
    minimum_rank_score: float | None = number(FINALISTS["minimum_rank_score"], Domain(0, 1, optional=True))

    def conflicts(self) -> list[str]:
        return ["minimum is above maximum"] if self.minimum > self.maximum else []


@dataclass(frozen=True)
class ExtendedThresholds(Checked):
    min_pre_active_minutes: int = number(EXTENDED["min_pre_active_minutes"], NATURAL)
    min_pre_dollar_volume: float = number(EXTENDED["min_pre_dollar_volume"], NATURAL)
    max_pre_abs_return: float = number(EXTENDED["max_pre_abs_return"], NATURAL)
    max_pre_abs_gap: float = number(EXTENDED["max_pre_abs_gap"], NATURAL)
    max_pre_range: float = number(EXTENDED["max_pre_range"], NATURAL)
    max_pre_volatility: float = number(EXTENDED["max_pre_volatility"], NATURAL)
    min_post_active_minutes: int = number(EXTENDED["min_post_active_minutes"], NATURAL)
    min_post_dollar_volume: float = number(EXTENDED["min_post_dollar_volume"], NATURAL)
    max_post_abs_return: float = number(EXTENDED["max_post_abs_return"], NATURAL)
    max_post_range: float = number(EXTENDED["max_post_range"], NATURAL)
    max_post_volatility: float = number(EXTENDED["max_post_volatility"], NATURAL)


@dataclass(frozen=True)
class ExecutionProfile(Checked):
    commission_per_order: float = number(EXECUTION["commission_per_order"], NATURAL)
    slippage_bps: float = number(EXECUTION["slippage_bps"], Domain(0, 10_000, "high"))
    manual_latency_seconds: float = number(EXECUTION["manual_latency_seconds"], NATURAL)
    fx_rate: float | None = number(EXECUTION["fx_rate"], Domain(0, open="low", optional=True))
    fx_fee_bps: float = number(EXECUTION["fx_fee_bps"], NATURAL)
    fill_ratio: float = number(EXECUTION["fill_ratio"], SHARE)

    def conflicts(self) -> list[str]:
        return ["fx_fee_bps without fx_rate"] if self.fx_fee_bps and self.fx_rate is None else []


@dataclass(frozen=True)
class ModelWindows(Checked):
    train: int = number(MODEL["train"], COUNT)
    validation: int = number(MODEL["validation"], COUNT)
    holdout: int = number(MODEL["holdout"], COUNT)

    @property
    def minimum_rows(self) -> int:
        return self.train + self.validation + self.holdout
