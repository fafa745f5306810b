"""Projections, filters and row-wise labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions import text as X
from marketprose.functions import words as W


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed one time per row, whatever is done with it later.

    A filter on a plain computed column, also the one Spark adds below an explode, is moved under
    the projection and computes the column again.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def unnest(df: DataFrame, keep: Sequence[str], value: Column, *names: str) -> DataFrame:
    """One row per array element: the kept columns, then position and element, or the element alone."""
    held = once(df.select(*keep, value.alias("_held")), "_held", F.col("_held"))
    make = F.posexplode if len(names) == 2 else F.explode
    return held.select(*keep, make("_held").alias(*names))


def detect_text_column(df: DataFrame, candidates: Sequence[str] = W.TEXT_COLUMNS) -> str:
    """The first candidate the table has; known from the schema, so nothing runs."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"no text column among {list(candidates)}")


def project(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Column subset, renamed when given as {old: new}."""
    pairs = columns.items() if isinstance(columns, Mapping) else ((c, c) for c in columns)
    return df.select(*[F.col(old).alias(new) for old, new in pairs])


def drop_null_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.na.drop(subset=[column])


def filter_ticker(df: DataFrame, ticker: str = "TSLA", column: str = "ticker") -> DataFrame:
    return df.filter(F.col(column) == ticker)


def filter_feed(items: DataFrame, feed: str = "articles") -> DataFrame:
    """Items of one feed that carry a link; the link comes out trimmed."""
    link = X.to_text(F.col("link"))
    return items.filter((F.col("feedname") == feed) & (link != "")).withColumn("link", link)


def filter_min_tokens(df: DataFrame, column: str = "clean", at_least: int = 3) -> DataFrame:
    """Rows whose text has at least that many whitespace tokens; 0 keeps all."""
    if at_least <= 0:
        return df
    return df.filter(F.size(X.split_tokens(F.col(column))) >= at_least)


def filter_nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(X.to_text(F.col(column)) != "")


def filter_year_text(df: DataFrame, column: str = "date", years: Sequence[int] = (2023, 2024, 2025)) -> DataFrame:
    """Rows whose date text mentions one of the years, wherever it stands."""
    return df.filter(F.col(column).cast("string").rlike("|".join(str(y) for y in years)))


def filter_year(df: DataFrame, column: str = "date", years: Sequence[int] = (2023, 2024, 2025)) -> DataFrame:
    """The same for a date or timestamp, as range tests that prune files and partitions."""
    kind = dict(df.dtypes)[column]
    start = lambda year: F.lit(f"{year}-01-01").cast(kind)
    keep = F.lit(False)
    for year in years:
        keep = keep | ((F.col(column) >= start(year)) & (F.col(column) < start(year + 1)))
    return df.filter(keep)


def rule_flag(
    text: Column,
    rules: Sequence[tuple[str, Sequence[str]]] = W.CASE_RULES,
    match: str = "substring",
) -> Column:
    """Label of the first rule with a keyword in the text, ignoring case; null when there is none.

    ``match="word"`` asks for whole words, so that a short keyword does not fire inside others.
    """
    if match not in ("substring", "word"):
        raise ValueError(f"unknown match {match!r}")
    lowered = F.lower(text)

    def hits(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, keywords in reversed(list(rules)):
            test = F.lit(False)
            for keyword in keywords:
                if match == "substring":
                    test = test | low.contains(keyword.lower())
                else:
                    edge = f"[^{X.WORD}]"
                    test = test | low.rlike(rf"(^|{edge})\Q{keyword.lower()}\E($|{edge})")
            out = F.when(test, F.lit(label)).otherwise(out)
        return out

    return F.when(text.isNotNull(), X.bind(lowered, hits))


def split_label(date: Column, ranges: Sequence[tuple[str, str, str]] = W.SPLIT_RANGES, other: str = "exclude") -> Column:
    """Name of the closed date range the day falls in."""
    out = F.lit(other)
    for name, start, end in reversed(list(ranges)):
        inside = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def filter_split(df: DataFrame, column: str = "split", drop: str = "exclude") -> DataFrame:
    return df.filter(F.col(column) != drop)


def stamp(df: DataFrame, **literals: object) -> DataFrame:
    """Constant columns."""
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


def topic_rows(topics: DataFrame, topic: int) -> DataFrame:
    return topics.filter(F.col("topic") == topic)
