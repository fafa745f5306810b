"""Counts, calendars, histograms and per-day text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.functions.dates import coerce_date
from marketprose.operators.lookups import keyed_join
from marketprose.operators.select import once, unnest
from marketprose.operators.windows import numbered, range_buckets
from marketprose.session import written


def calendar_spine(counts: DataFrame, month: str = "month", value: str = "n") -> DataFrame:
    """Every month between the first and the last, with 0 where nothing was counted."""
    spine = counts.agg(
        F.explode(F.sequence(F.min(month), F.max(month), F.expr("interval 1 month"))).alias(month)
    )
    return spine.join(counts, month, "left").select(month, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))


def monthly_counts(articles: DataFrame, date: str = "date") -> DataFrame:
    """Articles per month (``month``, ``n``); unreadable dates are left out, empty months count 0."""
    day = coerce_date(F.col(date)) if dict(articles.dtypes)[date] == "string" else F.col(date)
    months = articles.select(F.to_date(F.trunc(day, "month")).alias("month")).filter("month IS NOT NULL")
    counts = months.groupBy("month").agg(F.count("*").alias("n"))
    return calendar_spine(counts)


def by_year_month(monthly: DataFrame) -> DataFrame:
    """Monthly counts labelled with the year and the short month name."""
    return monthly.select(
        F.year("month").alias("year"),
        F.month("month").alias("month_no"),
        F.date_format("month", "MMM").alias("month_name"),
        "n",
    )


def year_month_grid(monthly: DataFrame) -> DataFrame:
    """One row per year, one column per month."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    return by_year_month(monthly).groupBy("year").pivot("month_name", names).agg(F.sum("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def mean_of(df: DataFrame, column: str = "word_count", out: str = "mean") -> DataFrame:
    return df.agg(F.avg(column).alias(out))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max], empty ones included; the maximum falls in the last bin.

    When all values are equal the range is widened by half a unit on either side.
    """
    values = once(df, "x", F.col(column).cast("double")).select("x").filter("x IS NOT NULL")
    # one row per value, written: the bounds and the bins both come from here, the input is read once
    counted = written(values.groupBy("x").agg(F.count("*").alias("n")), "value-counts")
    bounds = counted.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    low, high = bounds["lo"], bounds["hi"]
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    counts = (
        counted.groupBy(F.least(F.width_bucket("x", lo, hi, F.lit(bins)), F.lit(bins)).alias("bin"))
        .agg(F.sum("n").alias("freq"))
    )
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    step = (hi - lo) / bins
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + step * (F.col("bin") - 1)).alias("bin_low"),
        (lo + step * F.col("bin")).alias("bin_high"),
        F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq"),
    )


def daily_text(
    articles: DataFrame,
    date: str = "date",
    text: str = "clean_text",
    order: str = "doc_id",
    bucket: Column | None = None,
) -> DataFrame:
    """The text of each day in pieces that never depend on its size: (date, seq, text), one per document.

    ``seq`` counts a day's documents from 0 in ``order``; joined by a space in that order they are the day's text.
    Null texts and null dates are left out, equal keys of ``order`` follow their texts' order.

    Documents are numbered inside buckets of like size, from the sizes of a day's earlier buckets; no day has to fit in one
    task, whatever the values of ``order`` are. A caller's ``bucket`` must not decrease with ``order``.
    """
    rows = articles.filter(F.col(date).isNotNull() & F.col(text).isNotNull()).select(
        F.col(date).alias("date"),
        F.col(order).alias("_o"),
        F.col(text).alias("_t"),
        *([] if bucket is None else [bucket.alias("_bucket")]),
    )
    if bucket is None:
        rows = range_buckets(rows, ["date", "_o", F.substring("_t", 1, 64)])  # a text's beginning sorts as the text does
    return numbered(rows, ["date"], ["_o", "_t"], "seq").select("date", (F.col("seq") - 1).alias("seq"), F.col("_t").alias(text))


def row_max(weights: Column) -> Column:
    return F.array_max(weights)


def row_argmax(weights: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def term_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """Token frequency (word, freq)."""
    return unnest(df, [], tokens, "word").groupBy("word").agg(F.count("*").alias("freq"))


def documents_per_term(df: DataFrame, terms: Column) -> DataFrame:
    """Documents holding each term (term, df): repeats go inside the row, before the shuffle."""
    return unnest(df, [], F.array_distinct(terms), "term").groupBy("term").agg(F.count("*").alias("df"))


def frequency_cut(
    frequency: DataFrame, documents: Column | int, min_df: int | float = 1, max_df: int | float = 1.0
) -> DataFrame:
    """Terms whose document count is inside the limits; whole numbers are counts, fractions are shares."""

    def limit(value):
        return F.lit(value) if isinstance(value, int) else F.lit(float(value)) * documents

    return frequency.filter((F.col("df") >= limit(min_df)) & (F.col("df") <= limit(max_df)))
