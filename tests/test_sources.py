"""Raw documents, files and the link stream."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marketprose.plans.ingest import ingest_articles, ingest_links
from marketprose.sources import pages as P
from marketprose.sources import prices as R
from marketprose.sources import search as S
from marketprose.sources import tables as T
from marketprose.streaming import links as L


def script(payload, tag='<script type="application/ld+json">'):
    return f"{tag}{payload if isinstance(payload, str) else json.dumps(payload)}</script>"


@pytest.mark.parametrize(
    "author, name",
    [
        (None, ""), ("", ""), (" Ann ", "Ann"), ({"name": " Ann "}, "Ann"), ({"name": None}, ""), ({"x": 1}, ""),
        (["Ann", {"name": "Bo"}, {"name": " "}, "", ["Cy", {"name": "Di"}]], "Ann, Bo, Cy, Di"), ([], ""),
        ("[not json", "[not json"), ("{odd", "{odd"), ("{braces} Jr", "{braces} Jr"), ([[[[["deep"]]]]], "deep"),
        (["a", 5, True, None, "z"], "a, z"), ({"name": ["x"]}, ""), ([{"x": {"name": "no"}, "name": "Z"}], "Z"), (7, ""),
        ('say "hi" \\ ]', 'say "hi" \\ ]'),
    ],
)
def test_clean_author(spark, author, name):
    page = script({"@type": "Article", "author": author})
    df = spark.createDataFrame([("u", page)], "link string, html string")
    assert P.article_pages_to_records(df).first()["author"] == name


def test_article_block_is_found(spark):
    article = {"@type": "NewsArticle", "headline": " H ", "articleBody": 'a "}" b'}
    pages = {
        "none": "<p>no script</p>",
        "broken first": script("{bad") + script(article),
        "second block": script({"@type": "WebPage", "headline": "no"}) + script(article),
        "list": script([{"@type": "X"}, article, {"@type": "Article", "headline": "later"}]),
        "single quotes": script(article, "<SCRIPT data-x='1' TYPE='application/ld+json' >"),
        "other type": script({"@type": "Product", "headline": "no"}),
        "other script": script(article, '<script type="text/javascript">'),
    }
    df = spark.createDataFrame(list(pages.items()), "link string, html string")
    rows = {r["link"]: r for r in P.article_pages_to_records(df).collect()}
    assert set(rows) == {"broken first", "second block", "list", "single quotes"}
    assert all((r["title"], r["content"]) == ("H", 'a "}" b') for r in rows.values())


def test_fallbacks_and_title_dedup(spark):
    pages = [
        ("a", script({"@type": "Article", "headline": "", "datePublished": None})),
        ("b", script({"@type": "Article", "headline": "T", "datePublished": "2024-02-01"})),
        ("c", script({"@type": "Article"})),
        ("not listed", script({"@type": "Article", "headline": "Z"})),
    ]
    links = spark.createDataFrame([("a", " T ", "2024-01-01"), ("b", "x", "y"), ("c", None, None)], "link string, title string, date string")
    df = spark.createDataFrame(pages, "link string, html string")
    rows = {r["link"]: (r["title"], r["date"]) for r in P.article_pages_to_records(df, links).collect()}
    assert rows == {"a": ("T", "2024-01-01"), "b": ("T", "2024-02-01"), "c": ("", ""), "not listed": ("Z", "")}
    assert {r["link"] for r in ingest_articles(df, links).collect()} == {"b", "c"}
    assert {r["link"] for r in ingest_articles(df, links, limit=1).collect()} == {"a"}


def search_page(items, total=2):
    return "x searchPage.resultcallback(" + json.dumps({"metadata": {"total": total}, "items": items}) + ");"


def landed(spark):
    item = lambda link, feed="articles", date="Sep 05, 2025", title=" t } ": {
        "feedname": feed, "link": link, "title": title, "pubdate": date,
    }
    rows = [
        ("q0", 0, 0, search_page([item("l1"), item(" l2 "), item("v", "video"), item(" "), item("l1", title="again")])),
        ("q1", 1, 0, search_page([item("l2", date="late"), item("l3", date="September 5, 2025")])),
        ("q1", 1, 500, "searchPage.resultcallback({bad json);"),
        ("q1", 1, 1000, "no callback"),
        ("q2", 2, 0, search_page([])),
    ]
    return spark.createDataFrame(rows, "query string, query_pos int, page_start int, body string")


def test_search_pages(spark):
    pages = landed(spark)
    assert S.search_batches_to_items(pages).count() == 7
    assert {(r["query_pos"], r["page_start"]) for r in S.malformed_pages(pages).collect()} == {(1, 500), (1, 1000)}
    links = {r["link"]: r for r in ingest_links(pages).collect()}
    assert {k: (v["title"], str(v["date"]), v["query"]) for k, v in links.items()} == {
        "l1": ("t }", "2025-09-05", "q0"),
        "l2": ("t }", "2025-09-05", "q0"),
        "l3": ("t }", "2025-09-05", "q1"),
    }
    assert [r["link"] for r in ingest_links(pages, sort=True).collect()] == ["l1", "l2", "l3"]


def test_price_charts(spark):
    def chart(stamps, n):
        quote = {k: [1.0] * n for k in ("open", "high", "low")} | {"close": [2.0, None][:n], "volume": [5, None][:n]}
        return json.dumps({"chart": {"result": [{"timestamp": stamps, "indicators": {"quote": [quote], "adjclose": [{"adjclose": [3.0] * n}]}}]}})

    rows = [("A", chart([1756433964, 1756520364], 2)), ("B", chart([0], 1)), ("C", '{"chart":{"result":[]}}'), ("D", "oops")]
    got = R.price_chart_to_rows(spark.createDataFrame(rows, "ticker string, body string")).orderBy("ticker", "datetime").collect()
    assert [(r["ticker"], r["datetime"], r["close"], r["volume"], r["adjclose"]) for r in got] == [
        ("A", "20250829", 2.0, 5, 3.0), ("A", "20250830", None, None, 3.0), ("B", "19700101", 2.0, 5, 3.0),
    ]
    assert (got[0]["year"], got[0]["month"], got[0]["day"], got[0]["table_name"]) == (2025, 8, 29, "daily_price")


def test_read_charts_from_files(spark, tmp_path):
    (tmp_path / "TSLA.json").write_text('{"a":\n1}')
    assert [tuple(r) for r in R.read_charts(spark, str(tmp_path)).collect()] == [("TSLA", '{"a":\n1}')]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", ok', "line\nbreak"), (2, "", " edges "), (3, None, "back\\slash")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    path = T.write_table(df, str(tmp_path / "t"), "csv", rows_per_file=1)
    rows[1] = (2, None, " edges ")  # CSV has one notation for empty and missing text
    assert sorted(tuple(r) for r in T.read_table_csv(spark, path, "id int, a string, b string").collect()) == rows
    nested = spark.createDataFrame([(["x", "y"],)], "t array<string>")
    path = T.write_table(nested, str(tmp_path / "n"), "csv")
    assert T.read_table_csv(spark, path, "t string").first()["t"] == '["x","y"]'


def test_csv_with_a_saved_row_index(spark, tmp_path):
    (tmp_path / "x.csv").write_text(',date,close\n0,2024-01-01,1.5\n1,2024-01-02,\n')
    path = str(tmp_path / "x.csv")
    inferred = T.read_table_csv(spark, path)
    assert inferred.columns == ["date", "close"] and dict(inferred.dtypes)["close"] == "double"
    typed = T.read_table_csv(spark, path, "close double, date string, missing int")
    assert [tuple(r) for r in typed.orderBy("date").collect()] == [(1.5, "2024-01-01", None), (None, "2024-01-02", None)]


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        T.read_table_csv(spark, str(tmp_path / "none.csv"), "a string").collect()


def test_partitioned_parquet_prunes(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    path = T.write_table(df, str(tmp_path / "p"), partition_by=["split"])
    plan = spark.read.parquet(path).filter("split = 'val'")
    assert "PartitionFilters: [isnotnull(split" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 1


def test_union_tables(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2,)], "id int")
    assert sorted(tuple(r) for r in T.union_tables(a, b).collect()) == [(1, "x"), (2, None)]


def test_stream_gives_each_link_once_also_after_a_restart(spark, tmp_path):
    pages = landed(spark)
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    pages.filter("query_pos = 0").select("body").write.text(src)

    def run():
        L.write_new_links(L.new_links(L.stream_pages(spark, src)), out, state).awaitTermination()
        return sorted(r["link"] for r in spark.read.parquet(out).collect())

    assert run() == ["l1", "l2"]
    assert run() == ["l1", "l2"]
    pages.filter("query_pos > 0").select("body").write.mode("append").text(src)
    assert run() == sorted(r["link"] for r in ingest_links(pages).collect()) == ["l1", "l2", "l3"]


def test_bounded_state_forgets_old_links_and_drops_late_ones(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "body string, seen timestamp"

    def land(*rows):
        pages = [(search_page([{"feedname": "articles", "link": l, "title": "t", "pubdate": ""}]), f"2024-01-{d:02d}") for l, d in rows]
        df = spark.createDataFrame(pages, "body string, seen string").withColumn("seen", F.to_timestamp("seen"))
        df.write.mode("append").parquet(src)
        stream = L.new_links(spark.readStream.schema(schema).parquet(src), within=("seen", "2 days"))
        query = L.write_new_links(stream, out, state)  # every call is a restart from the stored state
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(r["link"] for r in spark.read.parquet(out).collect()), kept[-1]

    assert land(("a", 1), ("b", 1), ("a", 1)) == (["a", "b"], 2)
    assert land(("a", 2), ("c", 2)) == (["a", "b", "c"], 3)  # repeated inside the delay, after a restart
    assert land(("d", 20)) == (["a", "b", "c", "d"], 1)  # a, b and c are forgotten
    assert land(("e", 5), ("d", 19)) == (["a", "b", "c", "d"], 1)  # e is too late, d is known
    assert land(("a", 21)) == (["a", "a", "b", "c", "d"], 2)  # long after: news again


def test_links_of_a_page_are_unique_before_the_shuffle(spark):
    page = search_page([{"feedname": "articles", "link": f"l{i % 3}", "title": str(i), "pubdate": ""} for i in range(500)])
    df = spark.createDataFrame([(page,)], "body string")
    parsed = df.select(F.from_json(S.page_json(F.col("body")), S.schemas.SEARCH_PAGE)["items"].alias("i"))
    assert parsed.select(F.size(L.page_links(F.col("i"), "articles"))).first()[0] == 3
