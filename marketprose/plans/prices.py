"""Daily prices to up and down flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from marketprose.functions import words as W
from marketprose.operators.select import filter_ticker
from marketprose.operators.windows import change_flags, day_order, lag_prices


def price_flags(
    prices: DataFrame,
    ticker: str | None = None,
    lags: Sequence[int] = W.LAGS,
    lag_col: str = "close",
    cur_col: str = "adjclose",
    order: str = "datetime",
    **lag_options,
) -> DataFrame:
    """Day numbers, lagged prices and flags for one ticker, or for all of them."""
    chosen = prices if ticker is None else filter_ticker(prices, ticker)
    return change_flags(lag_prices(day_order(chosen, order), lags, lag_col, cur_col, **lag_options), lags)
