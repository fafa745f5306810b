"""A part-of-speech tagger that the caller trains: an averaged perceptron over context features.

Training runs in shards of tagged sentences. In every round each shard starts from the same weights and makes a pass
over its sentences; the shards' weights are averaged and are the start of the next round. The model is the mean of the
weights after every single word of all passes, which is what a plain averaged perceptron gives when there is one shard.
Tags are chosen from left to right. Applying the model is an Arrow UDF from words to tags, which is what
``clean.clean_nouns_tagged`` and ``clean.preprocess_text`` take as ``tagger``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketprose.operators.select import once
from marketprose.session import written

BEFORE, AFTER = "<s>", "</s>"
Weights = dict[str, dict[str, float]]


def shape(word: str) -> str:
    """Capital, lower-case, digit and other signs, runs as one."""
    signs = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "." for c in word)
    return "".join(c for i, c in enumerate(signs) if not i or signs[i - 1] != c)


def features(words: Sequence[str], i: int, last: str, second: str) -> list[str]:
    """What is known of the word at ``i`` and of the words around it, and the two tags before it."""
    word = words[i]
    low = word.lower()
    left = words[i - 1].lower() if i else BEFORE
    right = words[i + 1].lower() if i + 1 < len(words) else AFTER
    return [
        "all", f"w={low}", f"e1={low[-1:]}", f"e2={low[-2:]}", f"e3={low[-3:]}", f"b={low[:1]}", f"s={shape(word)}",
        f"t={last}", f"tt={second}+{last}", f"tw={last}+{low}", f"l={left}", f"le={left[-3:]}", f"r={right}", f"re={right[-3:]}",
    ]


def best_tag(weights: Weights, found: Sequence[str], tags: Sequence[str]) -> str:
    """The tag with the highest score, the first in order of equals."""
    score = dict.fromkeys(tags, 0.0)
    for name in found:
        for tag, weight in weights.get(name, {}).items():
            score[tag] += weight
    return min(tags, key=lambda t: (-score[t], t))


def tag_words(weights: Weights, words: Sequence[str], tags: Sequence[str]) -> list[str]:
    out: list[str] = []
    last = second = BEFORE
    for i in range(len(words)):
        tag = best_tag(weights, features(words, i, last, second), tags)
        out.append(tag)
        last, second = tag, last
    return out


@dataclass
class Pass:
    """Weights while they are trained, with the sum of their values after every word."""

    weights: Weights
    tags: Sequence[str]
    steps: int = 0
    total: dict[tuple[str, str], float] = field(default_factory=lambda: defaultdict(float))
    since: dict[tuple[str, str], int] = field(default_factory=dict)

    def change(self, name: str, tag: str, by: float) -> None:
        row = self.weights.setdefault(name, {})
        held = row.get(tag, 0.0)
        # the value held after each of the words since the last change
        self.total[name, tag] += held * (self.steps - self.since.get((name, tag), 0))
        self.since[name, tag] = self.steps
        row[tag] = held + by

    def learn(self, words: Sequence[str], gold: Sequence[str]) -> None:
        last = second = BEFORE
        for i, right in enumerate(gold):
            found = features(words, i, last, second)
            guess = best_tag(self.weights, found, self.tags)
            if guess != right:
                for name in found:
                    self.change(name, right, 1.0)
                    self.change(name, guess, -1.0)
            self.steps += 1
            last, second = guess, last

    def sums(self) -> Iterator[tuple[str, str, float, float]]:
        """Feature, tag, weight, and the sum of its values after every word."""
        for name, row in self.weights.items():
            for tag, weight in row.items():
                yield name, tag, weight, self.total.get((name, tag), 0.0) + weight * (self.steps - self.since.get((name, tag), 0))


@dataclass
class Tagger:
    """A trained model; it has one weight per feature and tag that training has changed."""

    weights: Weights
    tags: list[str]

    def tag(self, words: Sequence[str]) -> list[str]:
        return tag_words(self.weights, words, self.tags) if self.tags else [""] * len(words)

    def udf(self, df: DataFrame) -> Callable:
        """An Arrow UDF from an array of words to an array of tags; null stays null. The model is sent to each worker once."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<string>")
        def tag(words: pd.Series) -> pd.Series:
            return words.map(lambda w: None if w is None else shared.value.tag(list(w)))

        return tag


def _training(start, tags: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One pass over a shard from the weights that are broadcast; a row without a feature counts shards and words."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        run = Pass({name: dict(row) for name, row in start.value.items()}, tags)
        part = part.assign(_w=part["words"].map(tuple), _t=part["tags"].map(tuple))
        for row in part.sort_values(["place", "_w", "_t"]).itertuples():
            run.learn(list(row.words), list(row.tags))
        return pd.DataFrame([*run.sums(), ("", "", 1.0, float(run.steps))], columns=["feature", "tag", "weight", "total"])

    return train


def fit_tagger(
    tagged: DataFrame,
    words: str = "words",
    tags: str = "tags",
    rounds: int = 5,
    max_sentences: int = 50_000,
    shard_sentences: int = 5_000,
) -> Tagger:
    """Train on sentences given as arrays of words and of their tags.

    The model and its training are bounded by ``max_sentences``: of longer tables those with the smallest hash of their
    words and tags are used. Rows whose arrays are null, empty or of different length are left out. A shard holds at most
    about ``shard_sentences``.
    """
    rows = tagged.select(F.col(words).alias("words"), F.col(tags).alias("tags"))
    rows = rows.filter("size(words) > 0 AND size(words) = size(tags) AND NOT exists(words, w -> w IS NULL) AND NOT exists(tags, t -> t IS NULL)")
    rows = rows.withColumn("place", F.xxhash64("words", "tags")).orderBy("place", "words", "tags").limit(max_sentences)
    rows = written(rows, "tagged-sentences")
    count = rows.count()
    names = sorted(r[0] for r in rows.select(F.explode("tags")).distinct().collect())
    shards = max(1, -(-count // shard_sentences))
    # neighbours by hash lie in different shards
    dealt = rows.withColumn("shard", F.pmod(F.shiftright("place", 20), F.lit(shards)))
    context = rows.sparkSession.sparkContext
    weights: Weights = {}
    total: dict[tuple[str, str], float] = defaultdict(float)
    steps = 0
    for _ in range(rounds if count else 0):
        start = context.broadcast(weights)
        found = dealt.groupBy("shard").applyInPandas(_training(start, names), "feature string, tag string, weight double, total double")
        mixed = found.groupBy("feature", "tag").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total")).collect()
        used = next(r["weight"] for r in mixed if not r["feature"])  # shards that have sentences
        weights = {}
        for r in mixed:
            if r["feature"]:
                weights.setdefault(r["feature"], {})[r["tag"]] = r["weight"] / used
                total[r["feature"], r["tag"]] += r["total"]
            else:
                steps += int(r["total"])
        start.unpersist()
    model: Weights = {}
    for (name, tag), value in total.items():
        if value:
            model.setdefault(name, {})[tag] = value / steps
    return Tagger(model, names)


def add_tags(df: DataFrame, tagger: Tagger, words: str, out: str = "tags") -> DataFrame:
    """Add the tags of an array of words."""
    return once(df, out, tagger.udf(df)(F.col(words)))
