"""Article pages: the JSON-LD block of landed HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.functions.text import strip_text, to_text
from marketprose.operators.lookups import link_pages

# a comment, a JSON-LD script (its text is the group), or another script, whichever comes first
SCRIPT = (
    r"(?is)<!--.*?-->|<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
    r"|<script\b[^>]*>.*?</script\s*>"
)
# the signs of JSON text that matter to its nesting: a string, a brace or bracket, anything between
JSON_SIGNS = r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+'
ARTICLE_TYPES = ("NewsArticle", "Article")


def json_ld_blocks(html: Column) -> Column:
    """The texts of the JSON-LD scripts that are not commented out."""
    return F.filter(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1)), lambda b: b != "")


def first_article(html: Column, types: Sequence[str] = ARTICLE_TYPES) -> Column:
    """The first object of an article type in the page's JSON-LD blocks, as a variant.

    Blocks that cannot be read are skipped, and so are items of a list that are no objects.
    """

    def items(block: Column) -> Column:
        value = F.try_parse_json(block)
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))

    found = F.flatten(F.transform(json_ld_blocks(html), items))
    return F.get(F.filter(found, lambda i: F.try_variant_get(i, "$['@type']", "string").isin(list(types))), 0)


def clean_author(author: Column) -> Column:
    """Author names from the JSON text of a string, an object with a name, or a list of those, however deep.

    Names are joined by a comma; other values give none.
    """
    signs = F.regexp_extract_all(author, F.lit(JSON_SIGNS), F.lit(0))
    start = F.expr("named_struct('depth', 0, 'text', '', 'items', cast(array() AS array<string>))")

    def step(now: Column, sign: Column) -> Column:
        # strings and objects outside of other objects are items; the brackets around them do not matter
        text = F.when(now["depth"] == 0, F.lit("")).otherwise(now["text"])
        text = F.when((now["depth"] > 0) | (sign == "{"), F.concat(text, sign)).otherwise(text)
        depth = now["depth"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        item = F.when((now["depth"] == 1) & (depth == 0), text).when((now["depth"] == 0) & sign.startswith('"'), sign)
        items = F.when(item.isNotNull(), F.concat(now["items"], F.array(item))).otherwise(now["items"])
        return F.struct(depth.alias("depth"), text.alias("text"), items.alias("items"))

    def name(item: Column) -> Column:
        value = F.try_parse_json(item)
        held = F.when(item.startswith("{"), F.try_variant_get(value, "$.name", "variant")).otherwise(value)
        # only strings are names
        return F.when(F.to_json(held).startswith('"'), strip_text(F.try_variant_get(held, "$", "string")))

    found = F.aggregate(signs, start, step)["items"]
    names = F.filter(F.transform(found, name), lambda n: n != "")
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first value that is neither null nor empty, trimmed; else empty."""
    return strip_text(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit("")))


def article_pages_to_records(pages: DataFrame, links: DataFrame | None = None, **join) -> DataFrame:
    """Articles (title, date, link, author, content) of the pages (link, html) that hold one.

    Missing headlines and dates come from the link table (link, title, date), one row per link;
    ``how="inner"`` keeps only pages it lists. Parsed fields travel to the join, not the HTML.
    """
    found = (
        pages.select("link", F.explode(F.array(first_article(F.col("html")))).alias("a"))
        .filter(F.col("a").isNotNull())
        .select(
            "link",
            *[F.try_variant_get("a", f"$.{c}", "string").alias(c) for c in ("headline", "datePublished", "articleBody")],
            F.to_json(F.try_variant_get("a", "$.author", "variant")).alias("author"),
        )
    )
    if links is not None:
        table = links.select("link", F.col("title").alias("_title"), F.col("date").cast("string").alias("_date"))
        found = link_pages(found, table, "link", **join)
    else:
        found = found.withColumns({"_title": F.lit(None).cast("string"), "_date": F.lit(None).cast("string")})
    return found.select(
        first_text(F.col("headline"), F.col("_title")).alias("title"),
        first_text(F.col("datePublished"), F.col("_date")).alias("date"),
        "link",
        clean_author(F.col("author")).alias("author"),
        to_text(F.col("articleBody")).alias("content"),
    )
