"""Windows, aggregates, joins and sorts against brute force, with hot keys."""

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketprose.operators import aggregates as A
from marketprose.operators import lookups as J
from marketprose.operators import ordering as O
from marketprose.operators import windows as N
from marketprose.plans.prices import price_flags


def prices_frame(hot=700):
    rng = random.Random(5)
    rows = []
    for ticker, n in (("HOT", hot), ("MID", 40), ("ONE", 1)):
        days = pd.bdate_range("2011-01-03", periods=n * 2)[sorted(rng.sample(range(n * 2), n))]
        for d in days:
            close = rng.choice([1.0, 2.0, 2.0, 3.0])
            rows.append((ticker, d.strftime("%Y%m%d"), close, rng.choice([close, 2.0]) if rng.random() > 0.05 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 16, 4096])
def test_price_flags_match_one_pass_over_each_ticker(spark, block):
    rows = prices_frame()
    df = spark.createDataFrame(rows, "ticker string, datetime string, close double, adjclose double")
    got = {(r["ticker"], r["datetime"]): r for r in price_flags(df, block=block).collect()}
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        by[r[0]].append(r)
    for ticker, series in by.items():
        for i, (_, day, close, adj) in enumerate(series):
            r = got[(ticker, day)]
            assert r["day_order"] == i + 1
            for k in (1, 3, 5, 7):
                lag = series[i - k][2] if i >= k else None
                assert r[f"T_minus_{k}_price"] == lag
                assert r[f"change_vs_T_minus_{k}"] == int(lag is not None and adj is not None and adj > lag)


def test_price_flags_for_one_ticker(spark):
    df = spark.createDataFrame(prices_frame(), "ticker string, datetime string, close double, adjclose double")
    assert price_flags(df, "MID").count() == 40


def test_no_window_holds_a_whole_ticker(spark):
    df = spark.createDataFrame(prices_frame(), "ticker string, datetime string, close double, adjclose double")
    plan = price_flags(df)._jdf.queryExecution().executedPlan().toString()
    parts = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line or "lag(" in line]
    assert parts and all("_bucket" in line or "_b#" in line for line in parts)


def test_monthly_counts_fill_gaps(spark):
    df = spark.createDataFrame([("2020-01-05",), ("2020-01-09",), ("2020-04-01",), ("bad",), (None,)], "date string")
    monthly = A.monthly_counts(df)
    assert [r["n"] for r in monthly.orderBy("month").collect()] == [2, 0, 0, 1]
    named = A.by_year_month(monthly).orderBy("month_no").collect()
    assert [(r["year"], r["month_name"]) for r in named] == [(2020, "Jan"), (2020, "Feb"), (2020, "Mar"), (2020, "Apr")]
    grid = A.year_month_grid(monthly).first()
    assert (grid["Jan"], grid["Feb"], grid["May"]) == (2, 0, None)


def test_histogram_edges(spark):
    one = A.histogram(spark.createDataFrame([(5,), (5,)], "x int"), "x").filter("freq > 0").collect()
    assert len(one) == 1 and one[0]["freq"] == 2 and one[0]["bin_low"] <= 5 <= one[0]["bin_high"]
    rows = A.histogram(spark.range(101), "id", 10).orderBy("bin").collect()
    assert [r["freq"] for r in rows] == [10] * 9 + [11]
    assert A.histogram(spark.createDataFrame([(0,), (100,), (None,)], "x int"), "x", 4).agg(F.sum("freq")).first()[0] == 2


def test_daily_text_pieces_keep_order_and_everything(spark):
    rng = random.Random(3)
    rows = [(i, "2020-01-01" if rng.random() < 0.6 else f"2020-01-{rng.randint(2, 4):02d}", f"w{i} " + "x" * rng.randint(0, 30)) for i in range(9000)]
    rows += [(9001, None, "lost"), (9002, "2020-01-02", None)]
    df = spark.createDataFrame(rows, "doc_id long, date string, clean_text string").withColumn("date", F.to_date("date"))
    want = defaultdict(list)
    for i, d, t in rows[:9000]:
        want[d].append(t)
    named = df.withColumn("doc_id", F.format_string("https://news.example.com/%06d", "doc_id"))
    for days in (A.daily_text(df), A.daily_text(df, bucket=F.floor(F.col("doc_id") / 16)), A.daily_text(named)):
        got = defaultdict(dict)
        for r in days.collect():
            got[str(r["date"])][r["seq"]] = r["clean_text"]
        assert {d: [t for _, t in sorted(pieces.items())] for d, pieces in got.items()} == want
        assert all(sorted(pieces) == list(range(len(pieces))) for pieces in got.values())


def test_buckets_are_of_like_size_whatever_the_keys(spark):
    """Random 64-bit ids of one day, ticks of one ticker in one month, and one time that most rows share."""
    rng = random.Random(8)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(40_000)]
    same = [0 if rng.random() < 0.7 else rng.randrange(1000) for _ in ids]
    df = spark.createDataFrame([("A", i, t) for i, t in zip(ids, same)], "ticker string, id long, time int")
    for order in (["ticker", "id"], ["ticker", "time", "id"]):
        sizes = [r["count"] for r in N.range_buckets(df, order, bucket_rows=2000).groupBy("_bucket").count().collect()]
        assert len(sizes) >= 19 and sum(sizes) == len(ids) and max(sizes) <= 2 * 2000
    got = {r["id"]: r["day_order"] for r in N.day_order(df, "id", bucket_rows=2000).collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(ids))}
    tied = N.day_order(df, "time", tie=["id"], bucket_rows=2000).orderBy("day_order").collect()
    assert [(r["time"], r["id"]) for r in tied] == sorted(zip(same, ids))
    assert [r["day_order"] for r in tied] == list(range(1, len(ids) + 1))
    assert N.day_order(df.limit(0), "id").collect() == []


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else None if rng.random() < 0.4 else f"k{rng.randint(0, 30)}") for i in range(4000)]
    big = spark.createDataFrame(rows, "id int, k string")
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(20)], "k string, v int")
    salted = J.salted_join(big, dim, ["k"], how, ["id"], hot_rows=100)
    key = lambda r: tuple(str(x) for x in r)
    columns = salted.columns
    assert sorted(salted.collect(), key=key) == sorted(big.join(dim, "k", how).select(columns).collect(), key=key)


def test_salted_join_splits_the_hot_key(spark):
    big = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = J.salted_join(big, dim, ["k"], "inner", ["id"], hot_rows=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 1334 and max(sizes) < 0.5 * 1334


def test_broadcast_only_below_the_limit(spark):
    big = spark.range(100).select("id", F.col("id").cast("string").alias("word"))
    dim = J.word_table(spark, ["1", "2"])
    assert J.table_bytes(dim) == 34
    kept = J.keyed_join(big, dim, "word", "left_anti")
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
    large = J.keyed_join(big, dim, "word", "left_anti", max_bytes=10)
    assert "_shard" in large._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == large.count() == 98


def test_lexicon_join_and_regroup(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "c")], "doc int, t string")
    lex = spark.createDataFrame([("a", "A"), ("a", "Z"), ("b", "B")], "word string, tag string")
    tokens = J.explode_tokens(docs, F.split("t", " "), "doc")
    out = J.regroup_tokens(J.lexicon_join(tokens, lex), "doc", F.coalesce("tag", "token"))
    assert {r["doc"]: r["tokens"] for r in out.collect()} == {1: ["B", "A", "B"], 2: ["c"]}


def test_first_and_top_per_key_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    first = N.first_per_key(df, "k", [F.desc("id")])
    assert {r["id"] for r in first.collect()} == {997, 998, 999}
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    top = N.top_per_group(df, "k", ["id"], 2)
    assert sorted((r["k"], r["rank"], r["id"]) for r in top.collect()) == [(0, 1, 0), (0, 2, 3), (1, 1, 1), (1, 2, 4), (2, 1, 2), (2, 2, 5)]


def test_dedup_and_sort(spark):
    rows = [("t", "2024-01-01", "b"), ("t", "2024-01-01", "a"), ("t", None, "c"), ("u", "zzz", "d"), (None, "x", "e"), (None, "y", "f")]
    df = spark.createDataFrame(rows, "title string, date string, link string")
    assert {(r["title"], r["link"]) for r in O.dedup_titles(df).collect()} == {("t", "a"), ("u", "d"), (None, "f")}
    ordered = [r["link"] for r in O.sort_date_desc(df).collect()]
    assert ordered[:2] == ["a", "b"] and set(ordered[2:]) == {"c", "d", "e", "f"}


def test_scan_limit_takes_rows_before_dropping_blank_links(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b"), (5, "c")], "id int, link string")
    assert [r["link"] for r in O.scan_limit(df, "id", 4).collect()] == ["a", "b"]


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0],), ([0.0, 0.0],)], "w array<double>")
    assert [tuple(r) for r in df.select(A.row_argmax(F.col("w")), A.row_max(F.col("w"))).collect()] == [(1, 2.0), (0, 0.0)]


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in A.value_counts(df, "x").collect()] == [("b", 2), ("a", 1)]


def test_document_frequency(spark):
    texts = ["a b a", "a c", "a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = A.documents_per_term(df, F.filter(F.split("t", " "), lambda w: w != ""))
    want = Counter(w for t in texts for w in set(t.split()))
    assert {r["term"]: r["df"] for r in counts.collect()} == dict(want)
    assert [r["term"] for r in A.frequency_cut(counts, 4, 1, 0.5).orderBy("term").collect()] == ["b", "c"]
    assert [r["term"] for r in A.frequency_cut(counts, 4, 2, 1.0).collect()] == ["a"]


def test_typed_year_filter_reaches_the_scan(spark, tmp_path):
    from marketprose.operators.select import filter_ticker, filter_year

    path = str(tmp_path / "p")
    spark.sql("SELECT DATE '2024-05-01' AS date, 'TSLA' AS ticker, 1.0D AS close").write.parquet(path)
    df = filter_ticker(filter_year(spark.read.parquet(path)))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df.select("close")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(ticker,TSLA)" in pushed and "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed


def test_stored_rows_leave_no_shuffle_files(spark):
    from marketprose.session import checkpointed, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    rows = lambda: spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count()
    for keep in (written, checkpointed):
        known = tracker.shuffleStatuses().size()
        kept = keep(rows())
        assert tracker.shuffleStatuses().size() <= known
        assert kept.count() == 10
    assert spark.conf.get(key) == before
