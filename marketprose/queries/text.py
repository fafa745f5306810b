"""Scalar functions, cleaning, tokens, keywords and sentiment over whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from marketprose.functions import dates as D
from marketprose.functions import lexical as L
from marketprose.functions import text as X
from marketprose.functions import words as W
from marketprose.operators import aggregates as A
from marketprose.operators import clean as C
from marketprose.operators import keywords as K
from marketprose.operators import lookups as J
from marketprose.operators import select as S
from marketprose.operators import sentiment as V
from marketprose.operators import stopwords as SW
from marketprose.operators import tokens as T
from marketprose.queries import inputs as I
from marketprose.queries import sqlparts as P
from marketprose.queries.registry import query

def on_posts(name: str, spark_value: Callable[[Column], Column], sql_value: str) -> None:
    """A scalar function over every post."""

    @query(name, P.with_posts(f"SELECT post_id, {sql_value} AS out FROM posts"))
    def run(spark, sf_dir):
        return I.posts(spark, sf_dir).select("post_id", spark_value(F.col("fullText")).alias("out"))


def bar(tokens: Column) -> Column:
    return F.array_join(tokens, "|")


def sql_bar(tokens: str) -> str:
    return f"array_to_string({tokens}, '|')"


def tokens(text: Column) -> Column:
    return X.split_tokens(X.basic_cleanup(text))


SQL_TOKENS = P.split(P.cleanup('"fullText"'))
SQL_ROUGH = P.split('"fullText"')

on_posts("lower_text", F.lower, 'lower("fullText")')
on_posts("strip_urls", X.strip_urls, P.urls('"fullText"'))
on_posts("strip_mentions", X.strip_mentions, P.mentions('"fullText"'))
on_posts("strip_emoji", X.strip_emoji, P.emoji('"fullText"'))
on_posts("strip_punctuation", X.strip_punctuation, P.punctuation('"fullText"'))
on_posts("collapse_whitespace", X.collapse_whitespace, P.spaces('"fullText"'))
on_posts("split_tokens", lambda t: bar(X.split_tokens(t)), sql_bar(SQL_ROUGH))
on_posts("short_tokens", lambda t: bar(F.filter(tokens(t), X.is_short)), sql_bar(f"list_filter({SQL_TOKENS}, lambda w: length(w) <= 2)"))
on_posts(
    "upper_codes",
    lambda t: bar(F.transform(tokens(t), lambda w: F.when(X.is_code(w), F.upper(w)).otherwise(w))),
    sql_bar(f"list_transform({SQL_TOKENS}, lambda w: CASE WHEN {P.code('w')} THEN upper(w) ELSE w END)"),
)
on_posts("word_runs", X.word_run_count, f"CAST(len({P.runs(chr(34) + 'fullText' + chr(34))}) AS BIGINT)")
on_posts("alpha_tokens", lambda t: bar(F.filter(X.split_tokens(t), X.is_alpha)), sql_bar(rf"list_filter({SQL_ROUGH}, lambda w: regexp_full_match(w, '\p{{L}}+'))"))
on_posts(
    "numeric_tokens",
    lambda t: F.concat_ws("/", bar(F.filter(tokens(t), X.is_numeric)), bar(F.filter(tokens(t), lambda w: ~X.has_ascii_word_char(w)))),
    rf"concat({sql_bar(rf'list_filter({SQL_TOKENS}, lambda w: regexp_full_match(w, ' + P.q(r'\p{N}+') + '))')}, '/', "
    rf"{sql_bar(rf'list_filter({SQL_TOKENS}, lambda w: NOT regexp_matches(w, ' + P.q('[a-z0-9_]') + '))')})",
)
on_posts("join_tokens", lambda t: X.join_tokens(X.split_tokens(t)), f"array_to_string({SQL_ROUGH}, ' ')")
on_posts(
    "web_tokens",
    lambda t: bar(F.filter(X.split_tokens(t), lambda w: X.is_url_like(w) | X.is_email_like(w))),
    sql_bar(
        f"list_filter({SQL_ROUGH}, lambda w: regexp_matches(lower(w), "
        + P.q(r"^(https?://.+|www\..+|[a-z0-9][a-z0-9.-]*\.(com|org|net|edu|gov|io|co|uk|de|fr|es|info|biz)(/.*)?)$")
        + ") OR regexp_matches(w, "
        + P.q(r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$")
        + "))"
    ),
)
on_posts("basic_cleanup", X.basic_cleanup, P.cleanup('"fullText"'))
on_posts("clean_simple", lambda t: C.clean_simple(X.to_text(t)), P.clean(P.to_text('"fullText"'), SW.CLEANING, False))
on_posts("clean_nouns", lambda t: C.clean_nouns(X.to_text(t)), P.clean(P.to_text('"fullText"'), SW.CLEANING, True))
@query(
    "clean_by_tables",
    P.with_posts(
        f"""SELECT post_id, array_to_string(list_transform(list_filter({SQL_TOKENS},
        lambda w: w NOT IN {P.words(SW.CLEANING)} AND length(w) > 2), lambda w: CASE WHEN {P.code('w')} THEN upper(w)
        ELSE CASE w {' '.join(f'WHEN {P.q(k)} THEN {P.q(v)}' for k, v in W.NOUN_LEMMAS.items())} ELSE w END END), ' ') AS clean FROM posts"""
    ),
)
def clean_by_tables(spark, sf_dir):
    stops = J.word_table(spark, SW.CLEANING)
    lemmas = J.mapping_table(spark, W.NOUN_LEMMAS, "word string, lemma string")
    return C.clean_by_tables(I.posts(spark, sf_dir), "post_id", "fullText", stops, lemmas)


on_posts(
    "lemmatize",
    lambda t: X.join_tokens(F.transform(tokens(t), lambda w: L.noun_lemma(w))),
    f"array_to_string(list_transform({SQL_TOKENS}, lambda w: {P.noun('w')}), ' ')",
)


@query(
    "human_date_to_iso",
    P.with_items(
        """SELECT item_id, coalesce(strftime(coalesce(try_strptime(pubdate, '%b %d, %Y'), try_strptime(pubdate, '%B %d, %Y')),
           '%Y-%m-%d'), pubdate, '') AS out FROM search_items"""
    ),
)
def human_date(spark, sf_dir):
    return I.search_items(spark, sf_dir).select("item_id", D.human_date_to_iso(F.col("pubdate")).alias("out"))


@query(
    "epoch_to_timestamp",
    "SELECT o_orderkey, strftime(to_timestamp(epoch(o_orderdate)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS out FROM orders",
)
def epoch(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(D.epoch_to_timestamp(seconds), "yyyy-MM-dd HH:mm:ss").alias("out")
    )


@query(
    "date_parts",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS datetime, CAST(year(o_orderdate) AS INT) AS year,
       CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders""",
)
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return I.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.compact_date(d).alias("datetime"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
    )


@query(
    "coerce_timestamp",
    P.with_articles("SELECT doc_id, strftime(try_cast(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS out FROM articles"),
)
def coerce(spark, sf_dir):
    return I.articles(spark, sf_dir).select(
        "doc_id", F.date_format(D.coerce_timestamp(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("out")
    )


@query("date_part", P.with_articles("SELECT doc_id, try_cast(date AS DATE) AS out FROM articles"))
def date_part(spark, sf_dir):
    return I.articles(spark, sf_dir).select("doc_id", D.coerce_date(F.col("date")).alias("out"))


@query(
    "preprocess_text",
    P.with_posts(
        f"""SELECT post_id, clean FROM (SELECT post_id, {P.clean(P.to_text('"fullText"'), SW.CLEANING, True)} AS clean FROM posts)
        WHERE len({P.split('clean')}) >= 3"""
    ),
)
def preprocess(spark, sf_dir):
    out, _ = C.preprocess_text(I.posts(spark, sf_dir), candidates=("fullText", "text"), min_tokens=3, use_pos=True)
    return out.select("post_id", "clean")


@query(
    "word_count",
    P.with_articles(f"SELECT doc_id, CAST(len({P.runs(P.to_text('content'))}) AS BIGINT) AS word_count FROM articles"),
)
def word_count(spark, sf_dir):
    return C.add_word_count(I.articles(spark, sf_dir), "content").select("doc_id", "word_count")


@query(
    "pos_filter",
    P.with_articles(
        f"""SELECT doc_id, {P.kept_words('content')} AS kept FROM (SELECT doc_id, content ||
        ' The , cars . - ... the, (of) "and" fast; U.S. 3.5' AS content FROM articles)"""
    ),
)
def pos_filter(spark, sf_dir):
    """Article texts with marks alone and glued to words at their end."""
    text = F.concat("content", F.lit(' The , cars . - ... the, (of) "and" fast; U.S. 3.5'))
    return I.articles(spark, sf_dir).select("doc_id", C.keep_pos(text).alias("kept"))


# ---- look-ups ----------------------------------------------------------------

_TOKEN_ROWS = rf"""tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_$]+')) AS token,
         generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_$]+'), 1) - 1 AS pos FROM documents)"""


def _token_rows(spark, sf_dir, together=False):
    docs = I.table(spark, sf_dir, "documents")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(K.KEYWORD_TOKEN), F.lit(0))
    return J.explode_tokens(docs, tokens, "doc_id", together=together)


@query(
    "stopword_anti_join",
    f"""WITH {_TOKEN_ROWS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS places
    FROM tokens WHERE token NOT IN {P.words(SW.KEYWORDS)} GROUP BY doc_id""",
)
def stop_anti(spark, sf_dir):
    kept = J.drop_stopwords(_token_rows(spark, sf_dir), J.word_table(spark, SW.KEYWORDS), spread=["doc_id", "pos"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("places"))


@query(
    "lexicon_join",
    f"""WITH {_TOKEN_ROWS}, lex AS (SELECT * FROM {P.values([(P.q(k), P.q(v)) for k, v in W.NOUN_LEMMAS.items()]
    + [(P.q(w), P.q(w + '*')) for w in W.ENGLISH_STOPS], 'word, lemma')})
    SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS lemmas
    FROM tokens LEFT JOIN lex ON token = word GROUP BY doc_id""",
)
def lexicon(spark, sf_dir):
    table = {**W.NOUN_LEMMAS, **{w: w + "*" for w in W.ENGLISH_STOPS}}
    lex = J.mapping_table(spark, table, "word string, lemma string")
    joined = J.lexicon_join(_token_rows(spark, sf_dir, together=True), lex, spread=["doc_id", "pos"])
    grouped = J.regroup_tokens(joined, "doc_id", F.coalesce("lemma", "token"))
    return grouped.select("doc_id", X.join_tokens(F.col("tokens")).alias("lemmas"))


@query(
    "build_stopwords",
    f"""SELECT word FROM {P.word_values(SW.stop_set(W.CLEANING_STOPS))}
    UNION SELECT lang FROM documents""",
)
def build_stops(spark, sf_dir):
    langs = I.table(spark, sf_dir, "documents").select(F.col("lang").alias("word"))
    return SW.build_stopwords(J.word_table(spark, W.ENGLISH_STOPS), J.word_table(spark, W.CLEANING_STOPS), langs)


@query(
    "protect_stopwords",
    f"""SELECT word FROM (SELECT word FROM {P.word_values(SW.stop_set(W.TOKEN_STOPS))} UNION SELECT lower(role) FROM conversations
    UNION SELECT 'tesla') WHERE word NOT IN ('elon musk', 'elon', 'musk', 'tesla', 'spacex', 'user')""",
)
def protect_stops(spark, sf_dir):
    roles = I.table(spark, sf_dir, "conversations").select(F.lower("role").alias("word"))
    base = SW.build_stopwords(J.word_table(spark, SW.stop_set(W.TOKEN_STOPS)), roles, J.word_table(spark, ["tesla"]))
    phrases = [(p,) for p, _ in W.PROTECTED_PHRASES] + [("user",)]
    return SW.protect_stopwords(base, spark.createDataFrame(phrases, "phrase string"))


# ---- keywords ----------------------------------------------------------------


def _sql_words(chunk: str) -> str:
    """Words of a chunk by replacing step by step, each mark set off by blanks."""
    x = f"CASE WHEN ends THEN regexp_replace({chunk}, {P.q(_SQL_END)}, {P.q(r'\1 . \2')}) ELSE {chunk} END"
    x = P.sub(P.sub(x, r",(\p{Nd})", r"＜\1"), r":(\p{Nd})", r"＞\1")
    for mark in (r"\.{2,}", "--", "''", r"[][;@#$%&?!*(){}<>\"`«»“”„‘’:,]"):
        x = P.sub(x, f"({mark})", r" \1 ")
    x = f"trim(translate({x}, '＜＞', ',:'))"
    x = P.sub(x, " +", " ")
    x = P.sub(x, rf"'([^\P{{L}}dmnst]|[\p{{N}}_])([^{P.WD}]|$)", r"' \1\2")
    x = P.sub(x, r"([^' ])('[smd]?)( |$)", r"\1 \2\3")
    x = P.sub(x, r"([^' ])('ll|'re|'ve|n't)( |$)", r"\1 \2\3")
    for joined in ("(can)(not)", "(d)('ye)", "(gim)(me)", "(gon)(na)", "(got)(ta)", "(lem)(me)", "(more)('n)", "(wan)(na)"):
        x = P.sub(x, rf"(^|[^{P.WD}]){joined}($|[^{P.WD}])", r"\1\2 \3\4")
    x = P.sub(x, rf"(^| )('t)(is|was)($|[^{P.WD}])", r"\1\2 \3\4")
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


_SQL_END = r"""([^.])\.([\])}>"'»”’]*)$"""
_SQL_CHUNKS = P.split("lower(text)")
_COUNTED = rf"""chunk_rows AS (
  SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS pos, len(c) AS size FROM (SELECT doc_id, {_SQL_CHUNKS} AS c FROM documents)),
dotted_rows AS (SELECT doc_id, chunk, pos, regexp_matches(chunk, {P.q(_SQL_END)}) AS dotted, pos = size - 1 AS last,
  regexp_replace(chunk, {P.q(rf'^[^{P.WD}]+|\.?[^{P.WD}.]*$')}, '', 'g') AS raw FROM chunk_rows),
word_rows AS (SELECT doc_id, chunk, pos, dotted, last,
  CASE WHEN regexp_full_match(raw, '\p{{Nd}}+([.,]\p{{Nd}}+)*') THEN '0' ELSE raw END AS bare_word FROM dotted_rows),
per_word AS (SELECT bare_word, count(*) FILTER (dotted) AS d, count(*) FILTER (NOT dotted) AS b FROM word_rows
  WHERE bare_word <> '' GROUP BY bare_word),
totals AS (SELECT sum(d) / sum(d + b) AS p FROM per_word),
sized AS (SELECT bare_word, d, b, p, len(bare_word) - len(replace(bare_word, '.', '')) AS inner_dots,
  len(replace(bare_word, '.', '')) AS letters FROM per_word, totals WHERE d > 0 AND bare_word <> '0'),
short AS (SELECT bare_word FROM sized WHERE
  2 * (d * ln(0.99 / p) + b * ln(0.01 / (1 - p))) * exp(-letters) * (inner_dots + 1) * pow(letters, -b) >= 0.3),
ended AS (SELECT doc_id, chunk, pos, dotted AND (last OR (bare_word NOT IN (SELECT bare_word FROM short)
  AND NOT regexp_full_match(bare_word, '\p{{L}}') AND bare_word <> '0')) AS ends FROM word_rows),
split_rows AS (SELECT doc_id, pos, {_sql_words('chunk')} AS w FROM ended),
placed AS (SELECT doc_id, pos, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split_rows),
counted AS (
  SELECT word, CAST(count(*) AS BIGINT) AS freq, min(struct_pack(a := doc_id, b := pos, c := place)) AS first
  FROM placed WHERE regexp_full_match(word, '\p{{L}}+') AND word NOT IN {P.words(SW.KEYWORDS)} GROUP BY word)"""


@query("keyword_frequency", f"WITH {_COUNTED} SELECT word, freq FROM counted ORDER BY freq DESC, first LIMIT 20")
def keyword_frequency(spark, sf_dir):
    return K.keyword_frequency(I.table(spark, sf_dir, "documents"), "text", "doc_id")


@query("topk_keywords", f"WITH {_COUNTED} SELECT word, freq FROM counted ORDER BY freq DESC, first LIMIT 500")
def topk_keywords(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    stops = J.word_table(spark, SW.KEYWORDS)
    return K.keyword_frequency(docs, "text", "doc_id", stops=stops, topn=500)


@query(
    "keyword_counts",
    f"WITH {_COUNTED} SELECT word, freq, first.a AS first_doc, CAST(first.b AS BIGINT) AS first_pos FROM counted",
)
def keyword_counts(spark, sf_dir):
    """Counts of all keywords with the document and the chunk in which each comes first."""
    counts = K.keyword_counts(I.table(spark, sf_dir, "documents"), "text", "doc_id")
    return counts.filter(~F.col("word").isin(list(SW.KEYWORDS))).select(
        "word",
        "freq",
        F.expr("first.first div 10000000000").alias("first_doc"),
        F.expr("first.first % 10000000000").cast("bigint").alias("first_pos"),
    )


_CLOUD_WORDS = rf"""words AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[{P.WD}][{P.WD}'']*'),
    lambda w: CASE WHEN ends_with(lower(w), '''s') THEN w[:-3] ELSE w END), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+')) AS w
  FROM documents),
singles AS (
  SELECT doc_id, pos, form FROM (SELECT doc_id, unnest(w) AS form, generate_subscripts(w, 1) AS pos FROM words)
  WHERE lower(form) NOT IN {P.words(w.lower() for w in SW.KEYWORDS)}),
doubles AS (
  SELECT doc_id, pos, concat(form, ' ', next) AS form
  FROM (SELECT doc_id, pos, form, lead(pos) OVER o AS np, lead(form) OVER o AS next FROM singles
        WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE np = pos + 1)"""


def _fold(source: str, out: str) -> str:
    return f"""{out}_forms AS (SELECT form, lower(form) AS key, count(*) AS n, min(struct_pack(a := doc_id, b := pos)) AS first
  FROM {source} GROUP BY form),
{out}_base AS (SELECT f.*, s.key IS NOT NULL AS plural,
    CASE WHEN s.key IS NOT NULL THEN f.key[:-2] ELSE f.key END AS base,
    CASE WHEN s.key IS NOT NULL THEN f.form[:-2] ELSE f.form END AS spelling
  FROM {out}_forms f LEFT JOIN (SELECT DISTINCT key FROM {out}_forms) s
    ON f.key LIKE '%s' AND f.key NOT LIKE '%ss' AND f.key[:-2] = s.key),
{out}_merged AS (SELECT base, spelling, sum(n) AS n, min(struct_pack(p := plural, a := first.a, b := first.b)) AS seen
  FROM {out}_base GROUP BY base, spelling),
{out}_std AS (SELECT base, arg_min(spelling, struct_pack(n := -n, p := seen.p, a := seen.a, b := seen.b)) AS standard,
    sum(n) AS total FROM {out}_merged GROUP BY base),
{out} AS (SELECT DISTINCT key, standard, total FROM {out}_base JOIN {out}_std USING (base))"""


_CLOUD_COUNTS = f"""{_CLOUD_WORDS}, {_fold('singles', 'uni')}, {_fold('doubles', 'bi')},
pairs AS (SELECT DISTINCT standard AS term, total AS c12, lower(split_part(standard, ' ', 1)) AS k1,
  lower(split_part(standard, ' ', 2)) AS k2 FROM bi),
scored AS (SELECT term, c12, a.standard AS w1, b.standard AS w2, CAST(a.total AS DOUBLE) AS c1, CAST(b.total AS DOUBLE) AS c2,
  (SELECT CAST(count(*) AS DOUBLE) FROM singles) AS nn FROM pairs JOIN uni a ON k1 = a.key JOIN uni b ON k2 = b.key),
parts AS (SELECT *, greatest(c2 / nn, 1e-10) AS p, greatest(1 - c2 / nn, 1e-10) AS np, greatest(c12 / c1, 1e-10) AS p1,
  greatest(1 - c12 / c1, 1e-10) AS np1, greatest((c2 - c12) / (nn - c1), 1e-10) AS p2,
  greatest(1 - (c2 - c12) / (nn - c1), 1e-10) AS np2 FROM scored WHERE nn > c1 AND nn > c2),
strong AS (SELECT term, c12, w1, w2 FROM parts WHERE -2 * (ln(p) * c12 + ln(np) * (c1 - c12)
  + ln(p) * (c2 - c12) + ln(np) * (nn - c1 - (c2 - c12))
  - ln(p1) * c12 - ln(np1) * (c1 - c12) - ln(p2) * (c2 - c12) - ln(np2) * (nn - c1 - (c2 - c12))) > 30),
taken AS (SELECT term, sum(n) AS t FROM (SELECT w1 AS term, c12 AS n FROM strong UNION ALL SELECT w2, c12 FROM strong) GROUP BY term),
singly AS (SELECT u.term, u.total - coalesce(t.t, 0) AS freq
  FROM (SELECT DISTINCT standard AS term, total FROM uni) u LEFT JOIN taken t ON u.term = t.term),
counts AS (SELECT term, CAST(freq AS BIGINT) AS freq FROM singly WHERE freq > 0
  UNION ALL SELECT term, CAST(c12 AS BIGINT) FROM strong)"""


@query("wordcloud_counts", f"WITH {_CLOUD_COUNTS} SELECT term, freq FROM counts")
def cloud_counts(spark, sf_dir):
    return K.cloud_counts(I.table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "wordcloud_weights",
    f"""WITH {_CLOUD_COUNTS} SELECT term, freq, round(freq / (SELECT CAST(max(freq) AS DOUBLE) FROM counts), 6) AS weight
    FROM counts ORDER BY freq DESC, term LIMIT 100""",
)
def cloud_weights(spark, sf_dir):
    out = K.cloud_weights(I.table(spark, sf_dir, "documents"), "text", "doc_id")
    return out.withColumn("weight", F.round("weight", 6))


# ---- tokens ------------------------------------------------------------------

PHRASES = (*W.PROTECTED_PHRASES, ("general public license", "general_public_license"))


def _sql_protect(x: str) -> str:
    for phrase, token in PHRASES:
        x = P.sub(x, rf"(?i)\b{phrase.replace(' ', f'[{P.SP}]+')}\b", token)
    return x


@query("protect_phrases", P.with_articles(f"SELECT doc_id, {_sql_protect('content')} AS out FROM articles"))
def protect_phrases(spark, sf_dir):
    return I.articles(spark, sf_dir).select("doc_id", T.protect_phrases(F.col("content"), PHRASES).alias("out"))


_STOPS = SW.token_stops(PHRASES)
_PLAIN = P.sub(_sql_protect(P.spaces("coalesce(content, '')")), r"(?i)n['’]t\b|['’](?:s|re|ve|ll|d|m)\b", " ")
# token rows in place of the nested arrays of the Spark side
def tagged_sql(pos: str, verb: str, noun: str, more: str = "", lexicon: str = "") -> str:
    """Tagged and kept tokens; ``lexicon`` joins ``lower(tok)`` and ``more`` hands its columns on."""
    return f"""tagged AS (
  SELECT doc_id, i, low, pos, CASE WHEN pos IN ('VERB', 'AUX') THEN {verb}
    WHEN pos = 'NOUN' THEN {noun} ELSE low END AS norm
  FROM (SELECT doc_id, i, lower(tok) AS low{more}, CASE
      WHEN lower(tok) IN {P.words(t for _, t in PHRASES)} THEN 'PROTECTED'
      WHEN regexp_full_match(tok, '[.!?]+') THEN 'END'
      WHEN regexp_full_match(tok, {P.q(T.URL_TOKEN)}) OR regexp_full_match(tok, {P.q(T.EMAIL_TOKEN)})
        OR regexp_full_match(tok, {P.q(T.DOMAIN_TOKEN)}) THEN 'WEB'
      WHEN regexp_matches(tok, '^\\p{{Lu}}') AND i > 1 AND NOT regexp_full_match(before, '[.!?]+') THEN 'PROPN'
      ELSE {pos} END AS pos
    FROM (SELECT doc_id, i, tok, lag(tok) OVER (PARTITION BY doc_id ORDER BY i) AS before
      FROM (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all({_PLAIN}, {P.q(T.TOKEN_PATTERN)}) AS t FROM articles))){lexicon})),
kept AS (SELECT * FROM tagged WHERE pos = 'PROTECTED' OR (pos <> 'END' AND norm NOT IN {P.words(_STOPS)}
    AND NOT regexp_full_match(norm, '\\p{{N}}+') AND regexp_matches(norm, '[a-z0-9_]')))"""


_TAGGED = tagged_sql(P.pos("lower(tok)"), P.verb("low"), P.noun("low"))
NOUNS = "pos IN ('PROTECTED', 'PROPN', 'NOUN')"


def sql_tokens(condition: str, column: str, tagged: str = _TAGGED) -> str:
    return f"""WITH articles AS ({I.ARTICLES}), {tagged}
    SELECT a.doc_id, coalesce(out, '') AS {column} FROM articles a LEFT JOIN (
      SELECT doc_id, string_agg(norm, ' ' ORDER BY i) AS out FROM kept WHERE {condition} GROUP BY doc_id) k ON a.doc_id = k.doc_id"""


def tokenized(spark, sf_dir, **options):
    return T.tokenize_articles(I.articles(spark, sf_dir), "content", PHRASES, **options)


@query("tokens_all", sql_tokens("true", "clean_text"))
def tokens_all(spark, sf_dir):
    return tokenized(spark, sf_dir, nouns=False).select("doc_id", "clean_text")


@query("tokens_nouns", sql_tokens(NOUNS, "clean_text_nouns"))
def tokens_nouns(spark, sf_dir):
    return tokenized(spark, sf_dir, words=False).select("doc_id", "clean_text_nouns")


def _sql_grams(x: str, n: int) -> str:
    inner = ", '_', ".join(f"{x}[i + {j}]" for j in range(n))
    return f"list_transform(generate_series(1, len({x}) - {n - 1}), lambda i: concat({inner}))"


@query(
    "ngrams",
    P.with_posts(
        f"""SELECT post_id, array_to_string({_sql_grams('t', 2)}, ' ') AS bigrams, array_to_string({_sql_grams('t', 3)}, ' ') AS trigrams
        FROM (SELECT post_id, {SQL_TOKENS} AS t FROM posts)"""
    ),
)
def ngrams(spark, sf_dir):
    return I.posts(spark, sf_dir).select(
        "post_id",
        X.join_tokens(X.ngrams(tokens(F.col("fullText")), 2)).alias("bigrams"),
        X.join_tokens(X.ngrams(tokens(F.col("fullText")), 3)).alias("trigrams"),
    )


@query(
    "tokens_with_ngrams",
    P.with_posts(
        f"""SELECT post_id, array_to_string(list_concat(t, {_sql_grams('t', 2)}, {_sql_grams('t', 3)}), ' ') AS plain,
        array_to_string(list_concat(c, {_sql_grams('c', 3)}), ' ') AS chained
        FROM (SELECT post_id, t, list_concat(t, {_sql_grams('t', 2)}) AS c FROM (SELECT post_id, {SQL_TOKENS} AS t FROM posts))"""
    ),
)
def with_ngrams(spark, sf_dir):
    posts = S.once(I.posts(spark, sf_dir), "t", tokens(F.col("fullText")))
    return posts.select(
        "post_id",
        X.join_tokens(T.with_ngrams(F.col("t"))).alias("plain"),
        X.join_tokens(T.with_ngrams(F.col("t"), chained=True)).alias("chained"),
    )


# ---- sentiment ---------------------------------------------------------------

_PUNCT = r"!-/:-@\[-`{-~"
_MARK = r"""(?:[.!?,;:\-'"]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"""
_SENT_WORDS = (
    f"list_transform(list_filter(regexp_split_to_array(content, {P.q(f'[{P.SP}]+')}), lambda w: length(w) > 1), "
    f"lambda w: regexp_replace(regexp_replace(w, {P.q(f'^{_MARK}([^{_PUNCT}]{{2,}})' + chr(92) + 'z')}, '\\1'), "
    f"{P.q(f'^([^{_PUNCT}]{{2,}}){_MARK}' + chr(92) + 'z')}, '\\1'))"
)


def _step(value: str, d: int) -> str:
    prev, damp = f"l{d}", W.DAMPING[d - 1]
    boost = f"CASE WHEN {prev} IN {P.words(W.BOOST_UP)} THEN 0.293 WHEN {prev} IN {P.words(W.BOOST_DOWN)} THEN -0.293 ELSE 0.0 END"
    loud = (
        f"CASE WHEN mixed AND {prev} IN {P.words((*W.BOOST_UP, *W.BOOST_DOWN))} AND upper(w{d}) = w{d} AND lower(w{d}) <> w{d} "
        "THEN 0.733 ELSE 0.0 END"
    )
    raised = f"({value} + (CASE WHEN {value} < 0 THEN -1 ELSE 1 END) * ({boost} + {loud}) * {damp})"
    negated = f"({prev} IN {P.words(W.NEGATIONS)} OR contains({prev}, 'n''t'))"
    if d == 1:
        factor = f"CASE WHEN {negated} THEN -0.74 ELSE 1.0 END"
    elif d == 2:
        factor = f"CASE WHEN w2 = 'never' AND w1 IN ('so', 'this') THEN 1.5 WHEN {negated} THEN -0.74 ELSE 1.0 END"
    else:
        factor = (
            "CASE WHEN (w3 = 'never' AND w2 IN ('so', 'this')) OR w1 IN ('so', 'this') THEN 1.25 "
            f"WHEN {negated} THEN -0.74 ELSE 1.0 END"
        )
    return f"CASE WHEN {prev} IS NULL OR {prev} IN (SELECT word FROM lex) THEN {value} ELSE {raised} * {factor} END"


def _idiom_sql(x: str) -> str:
    cases = " ".join(f"WHEN {P.q(k)} THEN {v}" for k, v in W.IDIOMS.items())
    return f"CASE {x} {cases} END"


SEED_VALENCES = f"SELECT * FROM {P.values([(P.q(k), f'CAST({v} AS DOUBLE)') for k, v in W.VALENCE.items()], 'word, v')}"


def sentiment_sql(valences: str) -> str:
    """Scores of all articles by the words and values ``v`` that ``valences`` selects."""
    return f"""WITH articles AS ({I.ARTICLES}),
lex AS ({valences}),
split AS (SELECT doc_id, content, {_SENT_WORDS} AS ws FROM articles WHERE content IS NOT NULL),
toks AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split),
caps AS (SELECT doc_id, count(*) FILTER (upper(w) = w AND lower(w) <> w) AS up, count(*) AS n,
  min(i) FILTER (lower(w) = 'but') AS but FROM toks GROUP BY doc_id),
near AS (SELECT doc_id, i, w, lower(w) AS l0, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2, lag(w, 3) OVER o AS w3,
  lead(w, 1) OVER o AS n1, lead(w, 2) OVER o AS n2, min(i) OVER (PARTITION BY doc_id, w) AS firsti
  FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ctx AS (SELECT h.doc_id, h.i, f.w, f.l0, f.w1, f.w2, f.w3, f.n1, f.n2, lower(f.w1) AS l1, lower(f.w2) AS l2, lower(f.w3) AS l3,
  lex.v, up > 0 AND up < n AS mixed, but
  FROM near h JOIN near f ON h.doc_id = f.doc_id AND f.i = h.firsti JOIN lex ON h.l0 = lex.word JOIN caps ON caps.doc_id = h.doc_id),
s0 AS (SELECT *, CASE WHEN upper(w) = w AND lower(w) <> w AND mixed THEN CASE WHEN v > 0 THEN v + 0.733 ELSE v - 0.733 END ELSE v END AS a FROM ctx),
s1 AS (SELECT *, {_step('a', 1)} AS b FROM s0),
s2 AS (SELECT *, {_step('b', 2)} AS c FROM s1),
s3 AS (SELECT *, {_step('c', 3)} AS d0 FROM s2),
s4 AS (SELECT *, CASE WHEN l3 IS NULL OR l3 IN (SELECT word FROM lex) THEN d0 ELSE
    coalesce({_idiom_sql("concat(w, ' ', n1, ' ', n2)")}, {_idiom_sql("concat(w, ' ', n1)")}, {_idiom_sql("concat(w1, ' ', w)")},
      {_idiom_sql("concat(w2, ' ', w1, ' ', w)")}, {_idiom_sql("concat(w2, ' ', w1)")}, {_idiom_sql("concat(w3, ' ', w2, ' ', w1)")},
      {_idiom_sql("concat(w3, ' ', w2)")}, d0)
    - CASE WHEN concat(w3, ' ', w2) IN {P.words(W.BOOST_DOWN_PHRASES)} OR concat(w2, ' ', w1) IN {P.words(W.BOOST_DOWN_PHRASES)}
      THEN 0.293 ELSE 0 END END AS d FROM s3),
s5 AS (SELECT doc_id, i, but, CASE WHEN l0 = 'kind' AND lower(n1) = 'of' OR l0 IN {P.words((*W.BOOST_UP, *W.BOOST_DOWN))} THEN 0.0
    WHEN l1 = 'least' AND 'least' NOT IN (SELECT word FROM lex) AND (l2 IS NULL OR l2 NOT IN ('at', 'very')) THEN d * -0.74 ELSE d END AS e FROM s4),
total AS (SELECT doc_id, sum(e * CASE WHEN but IS NULL OR i = but THEN 1.0 WHEN i < but THEN 0.5 ELSE 1.5 END) AS s FROM s5 GROUP BY doc_id),
marks AS (SELECT doc_id, least(len(regexp_extract_all(content, '!')), 4) * 0.292 + CASE WHEN len(regexp_extract_all(content, '\\?')) <= 1 THEN 0
    WHEN len(regexp_extract_all(content, '\\?')) <= 3 THEN len(regexp_extract_all(content, '\\?')) * 0.18 ELSE 0.96 END AS m
  FROM articles WHERE content IS NOT NULL),
moved AS (SELECT t.doc_id, CASE WHEN s > 0 THEN s + m WHEN s < 0 THEN s - m ELSE s END AS s FROM total t JOIN marks USING (doc_id)),
final AS (SELECT a.doc_id, CASE WHEN s IS NULL THEN 0.0 ELSE round(greatest(-1.0, least(1.0, s / sqrt(s * s + 15))), 4) END AS score
  FROM articles a LEFT JOIN moved m ON a.doc_id = m.doc_id)
SELECT doc_id, score AS compound_score, CASE WHEN score >= 0.05 THEN 'Positive' WHEN score <= -0.05 THEN 'Negative'
  ELSE 'Neutral' END AS sentiment_label FROM final"""


@query("sentiment_lexicon", sentiment_sql(SEED_VALENCES))
def sentiment(spark, sf_dir):
    return V.add_sentiment(I.articles(spark, sf_dir)).select("doc_id", "compound_score", "sentiment_label")
