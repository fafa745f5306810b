"""Token operators with word tables too long for a plan: one word in every two of the corpus is listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.functions import words as W
from marketprose.operators import clean as C
from marketprose.operators import select as S
from marketprose.operators import sentiment as V
from marketprose.operators import stopwords as SW
from marketprose.operators import tagger as G
from marketprose.queries import inputs as I
from marketprose.queries import sqlparts as P
from marketprose.queries import text as Q
from marketprose.queries.registry import query

# every word of four or more letters a-z in the documents, but those of six and nine letters
LEXICON = """SELECT word, CASE length(word) % 4 WHEN 0 THEN 'VERB' WHEN 1 THEN 'ADJ' WHEN 2 THEN 'NOUN' ELSE 'ADV' END AS lpos,
  concat(word, 'n') AS lnoun, concat(word, 'v') AS lverb, CASE WHEN length(word) % 5 = 0 THEN (length(word) % 7 - 3) * 0.5 END AS valence
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents)
  WHERE length(word) NOT IN (6, 9)"""


def lexicon(spark, sf_dir) -> DataFrame:
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    words = I.table(spark, sf_dir, "documents").select(found.alias("word")).distinct().filter("length(word) NOT IN (6, 9)")
    rest = F.length("word") % 4
    pos = F.when(rest == 0, "VERB").when(rest == 1, "ADJ").when(rest == 2, "NOUN").otherwise("ADV")
    valence = F.when(F.length("word") % 5 == 0, (F.length("word") % 7 - 3) * 0.5)
    return words.select(
        "word", pos.alias("pos"), F.concat("word", F.lit("n")).alias("noun"), F.concat("word", F.lit("v")).alias("verb"),
        valence.alias("valence"),
    )


def _posts(value: str, condition: str, column: str) -> str:
    cleaned = P.split(P.cleanup(P.to_text('"fullText"')))
    return f"""WITH posts AS ({I.POSTS}), lex AS ({LEXICON}),
    rows AS (SELECT post_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT post_id, {cleaned} AS t FROM posts)),
    kept AS (SELECT post_id, string_agg({value}, ' ' ORDER BY i) AS out FROM rows LEFT JOIN lex ON w = word WHERE {condition} GROUP BY post_id)
    SELECT p.post_id, coalesce(out, '') AS {column} FROM posts p LEFT JOIN kept k ON p.post_id = k.post_id"""


_NOUN = f"coalesce(lnoun, {P.noun_rules('w')})"


@query(
    "clean_nouns_table",
    _posts(
        f"CASE WHEN {P.code('w')} THEN upper(w) ELSE {_NOUN} END",
        f"w NOT IN {P.words(SW.CLEANING)} AND length(w) > 2 AND ({P.code('w')} OR coalesce(lpos, {P.pos_rules('w')}) = 'NOUN')",
        "clean",
    ),
)
def clean_nouns_table(spark, sf_dir):
    posts = I.posts(spark, sf_dir)
    cleaned = C.clean_nouns_by_lexicon(posts, "post_id", X.to_text(F.col("fullText")), lexicon(spark, sf_dir))
    return cleaned.select("post_id", "clean")


@query("lemmatize_table", _posts(_NOUN, "true", "lemmas"))
def lemmatize_table(spark, sf_dir):
    tokens = X.split_tokens(X.basic_cleanup(X.to_text(F.col("fullText"))))
    found = C.lemmatize_by_lexicon(I.posts(spark, sf_dir), "post_id", tokens, lexicon(spark, sf_dir))
    return found.select("post_id", X.join_tokens(F.col("lemmas")).alias("lemmas"))


@query(
    "pos_filter_table",
    f"""WITH articles AS ({I.ARTICLES}), lex AS ({LEXICON}),
    rows AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {P.spoken_words('content')} AS t FROM articles)),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS out FROM rows LEFT JOIN lex ON lower(w) = word
      WHERE coalesce(lpos, {P.pos_rules('lower(w)')}) IN {P.words(W.KEPT_POS)} GROUP BY doc_id)
    SELECT a.doc_id, CASE WHEN a.content IS NOT NULL THEN coalesce(out, '') END AS kept FROM articles a LEFT JOIN kept k ON a.doc_id = k.doc_id""",
)
def pos_filter_table(spark, sf_dir):
    return C.keep_pos_by_lexicon(I.articles(spark, sf_dir), "doc_id", F.col("content"), lexicon(spark, sf_dir), keep=["doc_id"])


_TAGGED = f"lex AS ({LEXICON}), " + Q.tagged_sql(
    f"coalesce(lpos, {P.pos_rules('lower(tok)')})",
    f"coalesce(lverb, {P.verb_rules('low')})",
    f"coalesce(lnoun, {P.noun_rules('low')})",
    ", lverb, lnoun",
    " AS found LEFT JOIN lex ON lower(tok) = word",
)


@query("tokens_all_table", Q.sql_tokens("true", "clean_text", _TAGGED))
def tokens_all_table(spark, sf_dir):
    return Q.tokenized(spark, sf_dir, nouns=False, lexicon=lexicon(spark, sf_dir), keep=["doc_id"]).select("doc_id", "clean_text")


@query("tokens_nouns_table", Q.sql_tokens(Q.NOUNS, "clean_text_nouns", _TAGGED))
def tokens_nouns_table(spark, sf_dir):
    return Q.tokenized(spark, sf_dir, words=False, lexicon=lexicon(spark, sf_dir), keep=["doc_id"]).select("doc_id", "clean_text_nouns")


@query(
    "sentiment_table",
    Q.sentiment_sql(f"SELECT word, CAST(valence AS DOUBLE) AS v FROM ({LEXICON}) WHERE valence IS NOT NULL"),
)
def sentiment_table(spark, sf_dir):
    scored = V.add_sentiment(I.articles(spark, sf_dir), table=lexicon(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", "compound_score", "sentiment_label")


@query("perceptron_tags")
def perceptron_tags(spark, sf_dir):
    """Tags of every post's words by a tagger trained on sentences of the articles, which the seed lists have tagged."""
    articles = I.articles(spark, sf_dir).select(F.explode(F.split("content", "[.!?]+")).alias("sentence"))
    words = S.once(articles, "words", F.filter(X.word_tokens(F.col("sentence")), lambda w: w != ""))
    taught = words.withColumn("tags", F.transform("words", lambda w: L.pos_tag(F.lower(w))))
    model = G.fit_tagger(taught, rounds=3, max_sentences=4_000, shard_sentences=1_000)
    posts = S.once(I.posts(spark, sf_dir), "words", X.word_tokens(F.col("fullText")))
    return G.add_tags(posts, model, "words").select("post_id", F.concat_ws(" ", "tags").alias("tags"))
