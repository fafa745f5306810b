"""Word tables of any size, looked up for the token arrays of whole texts.

A table is a DataFrame with ``word`` and any of ``pos``, ``noun``, ``verb`` (lemmas) and ``valence``. Only token rows that the
table lists are gathered again; a text moves once, by its key or its block, and its tokens never move alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketprose.functions import lexical as L
from marketprose.operators.lookups import fits_broadcast
from marketprose.operators.select import once
from marketprose.session import written

BLOCK_WORDS = 1 << 20  # of texts that meet their part of a lexicon in one task, about
MAX_BLOCKS = 4000  # the blocks of a word are bits in a row; beyond that blocks grow


def spread_out(hits: Column, size: Column, kind: str) -> Column:
    """Sorted (p, v) pairs as an array of ``size`` values, null where no pair is; linear in the size."""
    none = F.lit(None).cast(kind)

    def upto(hit: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(hits, i - 1)["p"] + 1).otherwise(F.lit(0))
        return F.concat(F.array_repeat(none, hit["p"] - before), F.array(hit["v"]))

    used = F.coalesce(F.get(hits, F.size(hits) - 1)["p"] + 1, F.lit(0))
    listed = F.concat(F.flatten(F.transform(hits, upto)), F.array_repeat(none, size - used))
    return F.when(hits.isNull(), F.array_repeat(none, size)).otherwise(listed)


def _arrays(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if name.startswith("_") and kind == "array<string>"]


def _packed(df: DataFrame) -> DataFrame:
    """Arrays of words as one string each, half as large on disk; those that a blank would tear stay as they are."""
    text, words = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name in _arrays(df):
        odd = F.exists(name, lambda w: w.isNull() | w.contains(" "))
        joined = F.array_join(F.transform(name, lambda w: F.concat(F.lit(" "), w)), "")
        both = F.when(odd, F.struct(text.alias("s"), F.col(name).alias("a")))
        df = once(df, name, both.otherwise(F.struct(joined.alias("s"), words.alias("a"))))
    return df


def _unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    for name in _arrays(like):
        joined = F.col(f"{name}.s")
        words = F.when(joined == "", none).otherwise(F.split(F.substring(joined, 2, (1 << 31) - 1), " "))
        df = once(df, name, F.coalesce(f"{name}.a", words))
    return df


def _blocks(df: DataFrame) -> tuple[DataFrame, int]:
    """Written rows with the number of their block, and how many blocks there are.

    A block is a stretch of about ``BLOCK_WORDS`` words of what one task has written.
    """
    held = written(df, "lexicon-words", compression="zstd")
    task, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    by_task = held.groupBy(task.alias("task")).agg(F.max(place), F.count("*"), F.sum(F.greatest("_size", F.lit(0))))
    tasks = sorted(tuple(r) for r in by_task.collect())
    count, total = sum(r[2] for r in tasks), sum(r[3] or 0 for r in tasks)
    rows = max(1, count * max(BLOCK_WORDS, total // MAX_BLOCKS) // max(1, total))
    starts, blocks = [0] * (tasks[-1][0] + 1 if tasks else 1), 0
    for number, last, *_ in tasks:
        starts[number] = blocks
        blocks += last // rows + 1
    start = F.get(F.expr(f"array({', '.join(map(str, starts))})"), task)
    return held.withColumn("_block", (start + F.floor(place / rows)).cast("int")), max(1, blocks)


def _listed(rows: DataFrame, one: DataFrame, blocks: int) -> DataFrame:
    """For every block the lexicon's rows for its words, from rows (_block, _word).

    The blocks of a word are bits: words combine before the shuffle, and each meets the lexicon once.
    """
    masks = -(-blocks // 63)
    bit = lambda j: F.expr(f"if(_block div 63 = {j}, shiftleft(1L, cast(_block % 63 as int)), 0L)")
    found = rows.groupBy("_word").agg(*[F.bit_or(bit(j)).alias(f"_m{j}") for j in range(masks)]).join(one, "_word")
    numbers = F.sequence(F.lit(0), F.lit(62))

    def members(j: int) -> Column:
        here = F.transform(F.filter(numbers, lambda i: F.getbit(F.col(f"_m{j}"), i) == 1), lambda i: i + 63 * j)
        return F.when(F.col(f"_m{j}") != 0, here).otherwise(F.array().cast("array<int>"))

    return found.select(F.explode(F.flatten(F.array(*[members(j) for j in range(masks)]))).alias("_block"), "_word", "_v")


def look_up(
    df: DataFrame,
    key: str,
    words: Column,
    lexicon: DataFrame,
    out: str = "_found",
    only: Sequence[str] | None = None,
    cheap: bool = False,
    max_bytes: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``out``: for every word of the array its columns of the lexicon as a struct, null for words it does not list.

    ``key`` is unique and not null. Of repeated words in the lexicon the smallest row counts; ``only`` names the columns that
    are wanted; words that are ``cheap`` to make from the columns are made again instead of stored. A lexicon small enough
    goes to all tasks. For another the rows are written and dealt into blocks; each word meets the lexicon once, and its row
    goes to the blocks that have the word, so that no word is hot (``hot_rows`` changes nothing). The texts' rows move once; their words are taken apart and put together again where they lie.
    """
    values = [c for c in lexicon.columns if c != "word"]
    one = lexicon.filter("word IS NOT NULL").groupBy("word").agg(F.min(F.struct(*values)).alias("_v"))
    values = [c for c in values if only is None or c in only]
    one = one.select(F.col("word").alias("_word"), F.struct(*[F.col(f"_v.{c}").alias(c) for c in values]).alias("_v"))
    one = written(one, "lexicon")
    flat = one.select("_word", *[F.col(f"_v.{c}") for c in values])
    small = fits_broadcast(flat) if max_bytes is None else fits_broadcast(flat, max_bytes)
    given = df.columns
    if not cheap:
        df, words = once(df, "_words", words), F.col("_words")
    sought = F.when(F.col(key).isNotNull(), words)
    held = _packed(df.withColumns({"_size": F.size(words), "_at": F.monotonically_increasing_id()}))
    if small:
        repeated, by = True, [key]
        placed = held.repartition(key).withColumn("_listed", F.lit(None).cast("string"))
    else:
        held, blocks = _blocks(held)
        repeated, by = bool(held.groupBy(key).count().filter(F.col("count") > 1).take(1)), [key, "_block"]
        rows = _unpacked(held, df).select("_block", F.explode(sought).alias("_word")).filter("_word IS NOT NULL")
        listed = _listed(rows, one, blocks).withColumnRenamed("_word", "_listed")
        placed = held.unionByName(listed, allowMissingColumns=True).repartitionById(blocks, "_block")
    # a text comes once without a word, with its columns, then once for each word; a row of the lexicon as its word
    text = F.col("_listed").isNull()
    parts = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(sought, F.array().cast("array<string>")))
    moved = once(_unpacked(placed, df), "_parts", F.when(text, parts).otherwise(F.array("_listed")))
    rows = moved.select(*[c for c in moved.columns if c != "_parts"], F.posexplode("_parts").alias("_p", "_w"))
    first, rest = F.col("_p") == 0, [c for c in [*df.columns, "_size"] if c != key]
    # from here on only the first of a text's rows is wide
    rows = rows.select(*[c for c in rows.columns if c not in rest], *[F.when(first, F.col(c)).alias(c) for c in rest])
    if small:
        met = rows.join(F.broadcast(one), F.col("_w") == F.col("_word"), "left")
    else:
        # the word first: its letters tell rows apart at the first look, the block is one for all of a task
        word = Window.partitionBy("_w", "_block").orderBy(text).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = rows.withColumn("_v", F.first("_v", ignorenulls=True).over(word)).filter(text)
    hit = F.when(~first, F.struct((F.col("_p") - 1).alias("p"), F.col("_v").alias("v")))
    columns = [F.any_value(c, True).alias(c) for c in rest]
    # one text's words
    found = met.filter(first | F.col("_v").isNotNull()).groupBy(*by, "_at").agg(*columns, F.array_sort(F.collect_list(hit)).alias("_hits"))
    if repeated:  # texts with the same key share what is found
        alike = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col("_at")))
        found = found.withColumn("_hits", F.array_sort(F.flatten(F.collect_list("_hits").over(alike))))
    kind = one.schema["_v"].dataType.simpleString()
    return once(found.select(*given, "_size", "_hits"), out, spread_out(F.col("_hits"), F.col("_size"), kind)).drop("_size", "_hits")


class Found:
    """What a lexicon says of the word at a place, with the ending rules for the rest."""

    def __init__(self, lexicon: DataFrame, found: str = "_found"):
        self.columns, self.found = set(lexicon.columns), found

    def value(self, name: str, i: Column, default: Column) -> Column:
        return F.coalesce(F.get(self.found, i)[name], default) if name in self.columns else default

    def pos(self, word: Column, i: Column) -> Column:
        return self.value("pos", i, L.pos_rules(word))

    def noun(self, word: Column, i: Column) -> Column:
        return self.value("noun", i, L.noun_rules(word))

    def verb(self, word: Column, i: Column) -> Column:
        return self.value("verb", i, L.verb_rules(word))

    def lemma(self, word: Column, pos: Column, i: Column) -> Column:
        return (
            F.when(pos.isin("VERB", "AUX"), self.verb(word, i)).when(pos == "NOUN", self.noun(word, i)).otherwise(word)
        )
