"""Walk-forward forecasts as a stream: each bar is forecast from state alone, then observed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from volpanel.functions.kernels import egarch_step
from volpanel.sources.schema import MODELS, Parameters

OUT = "asset string, date timestamp_ntz, log_return double, ewma double, garch double, egarch double, gjr_garch double, static_ensemble_variance double"
STATE = "date timestamp_ntz, close double, r double, ewma double, garch double, logv double, gjr double, errors array<double>"


def step(state: tuple | None, seed: float, r: float, p: Parameters, lookback: int) -> tuple[tuple[float, float, float, float], float | None, tuple]:
    """Forecasts and ensemble for the next bar from the state, and the state after its return is seen."""
    if state is None:
        s = (seed, seed, math.log(max(seed, 1e-300) * 1e4), seed)
        errors: list[float] = []
    else:
        before, *old, errors = state
        square = before * before
        s = (
            p.lam * old[0] + (1 - p.lam) * square,
            p.garch[0] + p.garch[1] * square + p.garch[2] * old[1],
            egarch_step(old[2], before, *p.egarch),
            p.gjr[0] + (p.gjr[1] + (p.gjr[2] if before < 0 else 0.0)) * square + p.gjr[3] * old[3],
        )
    forecast = (s[0], s[1], math.exp(s[2]) / 1e4, s[3])
    ensemble = None
    n = len(MODELS)
    if len(errors) == lookback * n:
        inverse = [1 / max(math.sqrt(sum(errors[i::n]) / lookback), 1e-12) for i in range(n)]
        ensemble = sum(w * f for w, f in zip(inverse, forecast, strict=True)) / sum(inverse)
    seen = [(f - r * r) ** 2 for f in forecast]
    return forecast, ensemble, (r, *s, (errors + seen)[-lookback * n :])


def walk_forward(bars: DataFrame, p: Parameters, lookback: int = 60) -> DataFrame:
    """Streaming forecasts of ``bars`` (asset, date, seed, and log_return or close).

    State per asset: the last date and close, four variances, the last return, and a ring of
    the last ``lookback`` squared errors of the four models.  With closes, the return is that
    from the close in the state, and an asset's first bar gives no row.  Bars of one
    micro-batch, which the source bounds, are put in order; a bar not later than the last one
    seen is dropped.  The output equals the batch operators'.
    """
    closes = "log_return" not in bars.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("date")
        last, close, held = None, None, None
        if state.exists:
            date, close, *kept = state.get
            last, held = pd.Timestamp(date), (*kept[:-1], list(kept[-1])) if kept[0] is not None else None
        out = []
        for row in rows.itertuples():
            if last is not None and row.date <= last:
                continue
            last = row.date
            if closes:
                before, close = close, row.close
                if before is None:
                    continue
                r = math.log(close / before)
            else:
                r = row.log_return
            forecast, ensemble, held = step(held, row.seed, r, p, lookback)
            out.append((key[0], row.date, r, *forecast, ensemble))
        if last is not None:
            state.update((last.to_pydatetime(), close, *(held or (None, None, None, None, None, []))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return bars.groupBy("asset").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(bars: DataFrame, p: Parameters, folder: str, lookback: int = 60) -> DataFrame:
    """Drive the stream over what there is now into a Parquet table under ``folder``; return that table."""
    query = walk_forward(bars, p, lookback).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.read.schema(OUT).parquet(f"{folder}/out")
