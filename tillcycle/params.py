"""Run parameters shared by the operators (the reference's frozen run context)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

MODES = ("bounded", "omniscient")
PROFILES = ("standard", "regulated")


def as_date(value: str | dt.date | dt.datetime) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


@dataclass(frozen=True)
class RunParams:
    """One operating-cycle request.

    ``start`` defaults to ``as_of - 90 days`` like the reference cycle.
    ``end_of_day`` False reproduces the reference's midnight bound (a date
    string compared with a timestamp); True makes the as-of day inclusive.
    """

    as_of: dt.date
    start: dt.date | None = None
    mode: str = "bounded"
    profile: str = "standard"
    run_id: str = "run"
    horizon: int = 28
    end_of_day: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "as_of", as_date(self.as_of))
        start = self.start if self.start is not None else self.as_of - dt.timedelta(days=90)
        object.__setattr__(self, "start", as_date(start))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.profile not in PROFILES:
            raise ValueError(f"profile must be one of {PROFILES}")
        if not self.start < self.as_of:
            raise ValueError("start must be before as_of")

    @property
    def period(self) -> str:
        return f"{self.start}/{self.as_of}"
