"""Traffic-light bands of the headline metrics."""

from __future__ import annotations

# Metric -> (condition for good, condition for warn or None)
BANDS = {
    "win_rate_pct": (">= 50", ">= 40"),
    "profit_factor": (">= 1.5", ">= 1"),
    "max_drawdown_pct": ("< 10", "< 20"),
    "sharpe_ratio": ("> 1", "> 0"),
    "sortino_ratio": ("> 1", "> 0"),
    "recovery_factor": ("> 1", None),
}
SIGNED = ["total_net_profit", "expectancy"]


def band(metric: str) -> str:
    good, warn = BANDS[metric]
    rest = f"WHEN {metric} {warn} THEN 'warn' ELSE 'bad'" if warn else "ELSE 'neutral'"
    return f"CASE WHEN {metric} {good} THEN 'good' {rest} END"


def sign_band(metric: str) -> str:
    return f"CASE WHEN {metric} > 0 THEN 'good' WHEN {metric} < 0 THEN 'bad' ELSE 'neutral' END"


def rating_columns() -> list[str]:
    return [f"{band(m)} AS {m}_rating" for m in BANDS] + [
        f"{sign_band(m)} AS {m}_rating" for m in SIGNED
    ]
