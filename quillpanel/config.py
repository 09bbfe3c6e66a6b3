"""Settings in one place; all are parameters of the functions that use them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    #: Universe of tickers; empty means every ticker that has prices.
    tickers: tuple[str, ...] = ()
    start_date: str = "1900-01-01"
    end_date: str = "9999-12-31"
    #: Wall-clock time at the exchange from which news belongs to the next day.
    session_cutoff: str = "16:00"
    market_tz: str = "America/New_York"
    #: Whole sessions added after the cutoff rule.
    extra_lag_sessions: int = 1
    #: The scorer whose rows count.
    model: str = "finlex-base"
    test_start: str = "2023-01-01"
    min_headlines_per_day: int = 1
    monitor_window: int = 60
    accuracy_floor: float = 0.50
    psi_threshold: float = 0.20
    cost_bps_per_side: float = 2.0
    min_names_per_day: int = 15
    warmup_days: int = 90
    tail_days: int = 10
    random_state: int = 42
    #: Fixed signs of the prior ranking.
    sign_prior: dict[str, float] = field(default_factory=lambda: {"sent_composite": 1.0, "news_vol_z": -1.0, "ret_1d": -1.0, "volume_z": -1.0})
    #: Parts of the sentiment composite.
    composite: tuple[str, ...] = ("sent_mean", "sent_net", "sent_ewma3", "sent_surprise")


SETTINGS = Settings()
