"""Schemas, calendar and frozen model parameters."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [T.StructField("asset", T.StringType()), T.StructField("date", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
)
BAR_COLUMNS = ("asset", "date", "open", "high", "low", "close")
MODELS = ("ewma", "garch", "egarch", "gjr_garch")
TARGETS = ("realized_var_proxy", "parkinson_var_proxy")
FEATURES = (
    "ewma_rmse_60", "garch_rmse_60", "egarch_rmse_60", "gjr_garch_rmse_60",
    "realized_vol_5", "realized_vol_20", "realized_vol_60", "vol_of_vol_30", "return_sign_lag1",
)
EXPECTED_ABS_NORMAL = 0.79788456080286541


@dataclass(frozen=True)
class Calendar:
    """Bounds of the periods; those of the hourly test panel by default, all inclusive."""

    oos: str = "2024-01-16 00:00:00"
    train: tuple[str, str] = ("2024-01-16 00:00:00", "2024-01-22 23:59:59")
    validation: tuple[str, str] = ("2024-01-23 00:00:00", "2024-01-26 23:59:59")
    test: tuple[str, str] = ("2024-01-27 00:00:00", "2024-01-31 23:59:59")

    @classmethod
    def between(cls, first: datetime.date, last: datetime.date) -> Calendar:
        """The first half of the days in sample; of the others, two quarters train, one validation, one test."""
        days = (last - first).days + 1
        starts = [first + datetime.timedelta(days=days * k // 8) for k in (4, 6, 7)] + [last + datetime.timedelta(days=1)]
        train, validation, test = ((f"{a} 00:00:00", f"{b - datetime.timedelta(days=1)} 23:59:59") for a, b in zip(starts, starts[1:], strict=False))
        return cls(train[0], train, validation, test)


@dataclass(frozen=True)
class Parameters:
    """Frozen parameters of the four recursions; EGARCH works on returns times 100."""

    lam: float = 0.94
    garch: tuple[float, float, float] = (0.05, 0.08, 0.90)  # omega, alpha, beta
    gjr: tuple[float, float, float, float] = (0.05, 0.03, 0.10, 0.90)  # omega, alpha, gamma, beta
    egarch: tuple[float, float, float, float] = (1.03, 0.10, -0.05, 0.90)  # omega_raw, alpha, gamma, beta
    extra: dict = field(default_factory=dict)


#: event type -> (category, sector): the asset dimension of the test panel.
DIMENSION = {
    "click": ("index", "traffic"), "view": ("index", "traffic"), "purchase": ("high_beta", "sales"),
    "signup": ("high_beta", "growth"), "logout": ("defensive", "traffic"),
}
