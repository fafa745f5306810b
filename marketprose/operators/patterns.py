"""Many literal patterns looked for in texts at once, through the rarest gram of every pattern.

A pattern is cut into tiles of at most ``TILE`` characters, and each tile is found by the one of its grams that the texts
hold least often. A text is opened in short windows; a gram meets its tiles with its window, which holds all that is needed to
compare them, so no text is moved or joined, whatever the number of patterns and the length of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketprose.operators.lookups import keyed_join
from marketprose.operators.select import unnest
from marketprose.session import written

TILE = 32  # characters compared at once
GRAM = 3  # characters of a gram; shorter tiles are their own gram
PIECE = 4096  # places of a text that are counted together
WINDOW = 96  # places of a text that share a window


def _pieces(df: DataFrame, key: str, text: Column, size: int, overlap: int) -> DataFrame:
    """(key, no, piece): ``size`` characters of a text, with the ``overlap`` characters after them."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), F.lit(1))
    return unnest(df, [key], cut, "no", "piece")


def _grams(length: int) -> Column:
    return F.regexp_extract_all("piece", F.lit(rf"(?s)(?=(.{{{length}}}))."), F.lit(1))


def gram_counts(df: DataFrame, key: str, text: str, grams: DataFrame, lengths: list[int], **join) -> DataFrame:
    """How often the texts hold each of the grams (column ``gram``): (gram, n), about."""
    pieces = _pieces(df, key, F.col(text), PIECE, GRAM - 1)
    held = unnest(pieces, [key], F.concat(*[_grams(n) for n in lengths]), "gram")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))  # combined before it meets the list
    return keyed_join(counts, grams, "gram", "left_semi", **join)


def tile_index(df: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, **join) -> DataFrame:
    """One row per tile of a pattern: (gram, offset, tile, at, tiles, row). Tiles whose gram no text holds are left out."""
    size = F.char_length(pattern)
    cut = patterns.filter(size > 0).select(
        F.struct(*patterns.columns).alias("row"),
        F.col(pattern).alias("_p"),
        F.ceil(size / TILE).cast("int").alias("tiles"),
        F.explode(F.sequence(F.lit(0), F.ceil(size / TILE).cast("int") - 1)).alias("_no"),
    )
    at = F.greatest(F.lit(0), F.least(F.col("_no") * TILE, F.char_length("_p") - TILE))  # the last ends with the pattern
    cut = cut.withColumn("at", at).withColumn("tile", F.substring("_p", F.col("at") + 1, F.lit(TILE))).drop("_p", "_no")
    width = F.least(F.char_length("tile"), F.lit(GRAM))
    places = F.sequence(F.lit(0), F.char_length("tile") - width)
    cut = written(cut.withColumn("offset", F.explode(places)).withColumn("gram", F.substring("tile", F.col("offset") + 1, width)), "tiles")
    grams = cut.select("gram").distinct()
    lengths = [r[0] for r in grams.select(F.char_length("gram")).distinct().collect()]  # at most GRAM numbers
    if not lengths:
        return cut
    counts = gram_counts(df, key, text, grams, lengths, **join)
    rated = keyed_join(cut, written(counts, "gram-counts"), "gram", "inner", spread=["tile", "at"], **join)
    best = F.min(F.struct("n", "offset", "gram"))
    # a tile without a counted gram is gone; one with some may still hold another that no text has, which costs nothing
    kept = rated.groupBy("row", "tiles", "at", "tile").agg(best.alias("_best"))
    return written(kept.select("_best.gram", "_best.offset", "tile", "at", "tiles", "row"), "tile-index")


def occurrences(df: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, **join) -> DataFrame:
    """Every place where a text holds a pattern: (key, start, the columns of ``patterns``).

    ``start`` counts code points from 0; places may overlap. Patterns are compared as they are and must be unique; null
    and empty ones, and null texts, are nowhere. Keys of the texts are unique.
    """
    index = tile_index(df, key, text, patterns, pattern, **join)
    width = F.char_length("gram")
    back, ahead, most, *_ = index.agg(
        F.max("offset"), F.max(F.char_length("tile") - F.col("offset")), F.max("tiles")
    ).first()
    back, ahead, most = back or 0, ahead or 1, most or 1
    lengths = [r[0] for r in index.select(width).distinct().collect()]  # at most GRAM numbers

    padded = F.concat(F.repeat(F.lit("\0"), F.lit(back)), F.col(text))
    pieces = _pieces(df, key, padded, WINDOW, back + ahead - 1)
    if len(lengths) < 2:
        grams = unnest(pieces, [key, "no", "piece"], _grams(*lengths or [GRAM]), "i", "gram")
    else:
        each = [F.transform(_grams(n), lambda g, i: F.struct(i.alias("i"), g.alias("gram"))) for n in lengths]
        grams = unnest(pieces, [key, "no", "piece"], F.concat(*each), "_g").select(key, "no", "piece", "_g.*")
    # the text begins after the padding; the places after the last one are the next window's
    grams = grams.filter(F.col("i").between(back, back + WINDOW - 1))
    place = F.col("no").cast("bigint") * WINDOW + F.col("i") - back

    met = keyed_join(grams, index, "gram", "inner", spread=[key, "no", "i"], **join)
    start = place - F.col("offset") - F.col("at")
    same = F.substring("piece", F.col("i") - F.col("offset") + 1, F.char_length("tile")) == F.col("tile")
    hits = met.filter(same & (start >= 0)).select(key, start.alias("start"), "tiles", "row")
    if most > 1:  # a pattern of several tiles is there where all of them are
        hits = hits.groupBy(key, "start", "tiles", "row").agg(F.count("*").alias("_n")).filter("_n = tiles")
    return hits.select(key, "start", "row.*")


def rule_flag_table(df: DataFrame, key: str, text: str, rules: DataFrame, **join) -> DataFrame:
    """``rule_flag`` for rules kept as a table (rule_pos, label, keyword) of any length: (key, flag_case).

    The first rule by position, then keyword, that the text holds as a substring, ignoring case; null if none. Keys are
    unique. Empty keywords match any text, null ones none.
    """
    lowered = rules.select(F.lower("keyword").alias("keyword"), "rule_pos", "label").filter("keyword IS NOT NULL")
    table = lowered.groupBy("keyword").agg(F.min(F.struct("rule_pos", "label")).alias("rule"))
    table = table.select("keyword", "rule.rule_pos", "rule.label")
    rank = F.struct("rule_pos", "keyword", "label")
    low = df.select(key, F.lower(F.col(text)).alias("_low"))
    hits = occurrences(low, key, "_low", table, "keyword", **join).select(key, rank.alias("hit"), F.lit(False).alias("read"))
    own = df.select(key, F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.col(text).isNotNull().alias("read"))
    first = own.union(hits).groupBy(key).agg(F.min("hit").alias("hit"), F.max("read").alias("read"))
    always = table.filter("keyword = ''").agg(F.min(rank)).scalar()
    return first.select(key, F.least("hit", F.when(F.col("read"), always))["label"].alias("flag_case"))
