"""Hot-word and sentiment queries over the message stream derived from ``conversations``.

Each query is a function (spark, sf_dir) -> DataFrame; ``ORACLE`` holds the equivalent DuckDB
SQL over the same parquet tables (the correctness gate), with identical column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.functions.text import clean, is_special
from textpulse.functions.time import bucket_ms
from textpulse.operators.aggregate import (
    count_windows,
    hot_words,
    hot_words_two_level,
    running_counts,
    sentiment_counts,
    sentiment_first_item,
)
from textpulse.operators.lexicon import classify, drop_blacklisted, lexicon
from textpulse.operators.tokenize import tokenize
from textpulse.sources.adapters import messages_from_conversations
from textpulse.sources.records import blacklist, word_values
from textpulse.sources.tables import read_table

# Query lexicon for the driver tables (the original's polarity lists are not part of it).
QUERY_NEGATIVE = ["the", "de"]
QUERY_POSITIVE = ["of", "la"]


def prepare_messages(conv: DataFrame, drop_special: bool = True) -> DataFrame:
    """conversations rows (batch or stream) -> messages with their 5-minute content bucket."""
    msgs = messages_from_conversations(conv)
    if drop_special:
        msgs = msgs.where(~((F.col("origin") == "bullet") & is_special("text")))
    return msgs.withColumn("bucket_ms", bucket_ms("sec"))


def messages(spark: SparkSession, sf_dir: str, drop_special: bool = True) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return prepare_messages(conv, drop_special)


def prepare_tokens(msgs: DataFrame, min_len: int | None = fixed.MIN_TOKEN_LENGTH,
                   blacklist_scope: str | None = None, strip_latin: bool = False) -> DataFrame:
    toks = tokenize(msgs, min_len=min_len, strip_latin=strip_latin,
                    keep=["av", "origin", "bucket_ms", "arrival_sec", "seq"])
    if blacklist_scope:
        toks = drop_blacklisted(toks, blacklist(msgs.sparkSession), scope=blacklist_scope)
    return toks


def tokens(spark: SparkSession, sf_dir: str, min_len: int | None = fixed.MIN_TOKEN_LENGTH,
           blacklist_scope: str | None = None, strip_latin: bool = False) -> DataFrame:
    return prepare_tokens(messages(spark, sf_dir), min_len, blacklist_scope, strip_latin)


def _lexicon(spark: SparkSession) -> DataFrame:
    return lexicon(word_values(spark, QUERY_NEGATIVE), word_values(spark, QUERY_POSITIVE))


def q_hot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot words: (bucket, word) pairs with count >= 10 (tokens of length >= 2)."""
    return hot_words(tokens(spark, sf_dir)).select("bucket_ms", "word", "cnt")


def q_hot_words_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholded per 5-minute arrival window, then accumulated per (day, bucket, word)."""
    return hot_words_two_level(tokens(spark, sf_dir)).select("day", "bucket_ms", "word", "cnt")


def q_hot_words_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts per (bucket, word) with the blacklist applied to replies only (no threshold)."""
    toks = tokens(spark, sf_dir, blacklist_scope="reply")
    return hot_words(toks, threshold=None).select("bucket_ms", "word", "cnt")


def q_sentiment_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity counts per (bucket, item, emotion); every token counts (no length filter)."""
    toks = classify(tokens(spark, sf_dir, min_len=None), _lexicon(spark))
    return sentiment_counts(toks).select("bucket_ms", "av", "emotion", "cnt")


def q_sentiment_by_bucket_first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity counts per (bucket, emotion) over the cleaned stream (length >= 2, blacklist on
    replies) with the item of each key's first record in source order."""
    toks = classify(tokens(spark, sf_dir, blacklist_scope="reply"), _lexicon(spark))
    return sentiment_first_item(toks, ["seq", "pos"]).select("bucket_ms", "emotion", "cnt", "first_av")


def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tokens(spark, sf_dir, blacklist_scope="reply")
    return running_counts(toks, ["bucket_ms", "word"], ["seq", "pos"])


def q_running_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token running count of its (bucket, word) key in source order."""
    return _running(spark, sf_dir).select("bucket_ms", "word", "seq", "pos", "running_cnt")


def q_count_window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running-count records cut into full windows of 200 in source order; records whose
    running count is above 10 are emitted with their window number."""
    running = _running(spark, sf_dir).select("bucket_ms", "word", "seq", "pos", "running_cnt")
    return count_windows(running, ["seq", "pos"], size=200, keep=F.col("running_cnt") > 10).select(
        "window_no", "bucket_ms", "word", "seq", "pos", "running_cnt"
    )


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special-message drop, then the two cleaning forms of each message."""
    msgs = messages(spark, sf_dir)
    return msgs.select(
        "seq",
        "origin",
        clean("text").alias("cleaned"),
        clean("text", strip_latin=True).alias("cleaned_no_latin"),
    )


def q_document_hot_words_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot words of whole documents per language: count >= 10, tokens of length >= 2."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"])
    toks = tokenize(docs, min_len=fixed.MIN_TOKEN_LENGTH, keep=["lang"], pos_col=None)
    return hot_words(toks, keys=("lang", "word")).select("lang", "word", "cnt")


# Han letters that stand for a to z in the stand-in input of the dictionary segmenter.
HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
LATIN = "abcdefghijklmnopqrstuvwxyz"


def _han(col: Column) -> Column:
    return F.translate(F.lower(col), LATIN, HAN)


def _han_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in input: the texts with a Han letter for every Latin one, and the words of the
    benchmark texts, written the same way."""
    texts = read_table(spark, sf_dir, "conversations", ["text"]).select(_han(F.col("text")).alias("text"))
    found = F.regexp_extract_all(_han(F.col("text")), F.lit(r"\p{IsHan}+"), 0)
    return texts, read_table(spark, sf_dir, "benchmark", ["text"]).select(F.explode(found).alias("word"))


def _often(toks: DataFrame) -> DataFrame:
    return toks.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= fixed.HOT_WORD_THRESHOLD)


def q_han_hot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of Han text by longest match, counted over all conversations (10 or more); the
    dictionary holds the words of two to five letters."""
    texts, words = _han_inputs(spark, sf_dir)
    dictionary = words.where(F.length("word").between(2, 5)).distinct()
    return _often(tokenize(texts, mode="dictionary", dictionary=dictionary, keep=[], pos_col=None))


def q_han_viterbi_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of Han text by likelihood, counted over all conversations (10 or more); the
    dictionary holds the words of up to five letters with their counts."""
    texts, words = _han_inputs(spark, sf_dir)
    counts = words.where(F.length("word") <= 5).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return _often(tokenize(texts, mode="lattice", dictionary=counts, keep=[], pos_col=None))


QUERIES = {
    "han_hot_words": q_han_hot_words,
    "han_viterbi_words": q_han_viterbi_words,
    "hot_words": q_hot_words,
    "hot_words_two_level": q_hot_words_two_level,
    "hot_words_blacklist": q_hot_words_blacklist,
    "sentiment_by_item": q_sentiment_by_item,
    "sentiment_by_bucket_first_item": q_sentiment_by_bucket_first_item,
    "running_word_count": q_running_word_count,
    "count_window_batches": q_count_window_batches,
    "clean_text": q_clean_text,
    "document_hot_words_by_lang": q_document_hot_words_by_lang,
}

# ---- DuckDB oracle SQL ------------------------------------------------------------------

MESSAGES_SQL = """
msgs AS (
  SELECT 'av' || CAST(conv_id AS VARCHAR) AS av,
         CASE WHEN role = 'user' THEN 'bullet' ELSE 'reply' END AS origin,
         role AS sender,
         CAST(1704067200 + conv_id * 61 + turn * 45 AS BIGINT) AS sec,
         CAST(1704067200 + conv_id * 61 + turn * 45 + turn * 150 AS BIGINT) AS arrival_sec,
         CAST(conv_id * 4294967296 + turn AS BIGINT) AS seq,
         text
  FROM conversations
),
kept AS (
  SELECT *, (sec - sec % 300) * 1000 AS bucket_ms FROM msgs
  WHERE NOT (origin = 'bullet' AND left(text, 1) = '[' AND right(text, 1) = ']' AND length(text) >= 2)
),
terms AS (
  SELECT av, origin, bucket_ms, arrival_sec, seq,
         unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word,
         CAST(unnest(generate_series(0, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) - 1)) AS INTEGER) AS pos
  FROM kept
),
toks AS (SELECT * FROM terms WHERE length(word) >= 2),
bl AS (SELECT unnest(['amp', 'av', 'nav', 'nn', 'AV', '这个', '回复']) AS w),
toks_bl AS (
  SELECT * FROM toks WHERE NOT (origin = 'reply' AND word IN (SELECT w FROM bl))
)
"""

POLARITY_SQL = (
    "CASE WHEN word IN ('the', 'de') THEN 'negative' "
    "WHEN word IN ('of', 'la') THEN 'positive' ELSE 'unknown' END"
)

RUNNING_SQL = """
running AS (
  SELECT bucket_ms, word, seq, pos,
         CAST(row_number() OVER (PARTITION BY bucket_ms, word ORDER BY seq, pos) AS BIGINT) AS running_cnt
  FROM toks_bl
)
"""

_HAN_SQL = f"translate(lower(text), '{LATIN}', '{HAN}')"

ORACLE = {
    "han_viterbi_words": f"""
WITH RECURSIVE counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_HAN_SQL}, '\\p{{Han}}+')) AS word FROM benchmark) WHERE length(word) <= 5 GROUP BY word),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts),
dict AS (SELECT word, CAST(round(1000 * ln(t / n)) AS BIGINT) AS cost FROM counts, total),
runs AS (SELECT run, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(regexp_replace({_HAN_SQL}, '[\\pP\\pS\\pZ]', '', 'g'), '\\p{{Han}}+|[^\\p{{Han}}\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS run FROM conversations) GROUP BY run),
han AS (SELECT row_number() OVER () AS r, run, n FROM runs WHERE regexp_matches(run, '^\\p{{Han}}')),
edges AS (
  SELECT r, e, k, dict.cost FROM han, unnest(range(1, length(run) + 1)) t(e), unnest(range(1, 6)) u(k)
  JOIN dict ON dict.word = substr(run, e - k + 1, k) WHERE k <= e
  UNION ALL SELECT r, e, 1, CAST(round(1000 * ln(2 * t)) AS BIGINT) FROM han, total, unnest(range(1, length(run) + 1)) t(e)),
ways AS (SELECT r, e, list(struct_pack(k := k, c := cost) ORDER BY k DESC) AS w FROM edges GROUP BY r, e),
steps AS (
  SELECT r, list(struct_pack(best := CAST([] AS BIGINT[]), back := '', w := w) ORDER BY e) AS s FROM ways GROUP BY r),
walk AS (  -- the costs of the last five prefixes, and the last word's length at every prefix
  SELECT r, list_reduce(list_prepend(struct_pack(best := [CAST(0 AS BIGINT)], back := '', w := s[1].w), s), lambda a, x: struct_pack(
    best := list_append(a.best, list_min(list_transform(x.w, lambda y: a.best[-y.k] + y.c)))[-5:],
    back := a.back || CAST(list_filter(x.w, lambda z: a.best[-z.k] + z.c = list_min(list_transform(x.w, lambda y: a.best[-y.k] + y.c)))[1].k AS VARCHAR),
    w := x.w)) AS done FROM steps),
ends AS (SELECT run, n, done.back AS back FROM han JOIN walk USING (r)),
terms AS (
  SELECT run, n, back, length(run) AS e, CAST(back[length(run)] AS BIGINT) AS k FROM ends
  UNION ALL SELECT run, n, back, e - k, CAST(back[e - k] AS BIGINT) FROM terms WHERE e > k
)
SELECT word, CAST(sum(n) AS BIGINT) AS cnt FROM (
  SELECT substr(run, e - k + 1, k) AS word, n FROM terms
  UNION ALL SELECT run, n FROM runs WHERE NOT regexp_matches(run, '^\\p{{Han}}')) GROUP BY word HAVING sum(n) >= 10""",
    "han_hot_words": f"""
WITH RECURSIVE dict AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all({_HAN_SQL}, '\\p{{Han}}+')) AS word FROM benchmark) WHERE length(word) BETWEEN 2 AND 5),
runs AS (SELECT run, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(regexp_replace({_HAN_SQL}, '[\\pP\\pS\\pZ]', '', 'g'), '\\p{{Han}}+|[^\\p{{Han}}\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS run FROM conversations) GROUP BY run),
han AS (SELECT * FROM runs WHERE regexp_matches(run, '^\\p{{Han}}')),
best AS (SELECT run, a, max(k) AS k FROM han, unnest(range(1, length(run) + 1)) t(a), unnest(range(2, 6)) u(k)
         JOIN dict ON dict.word = substr(run, a, k) WHERE a + k - 1 <= length(run) GROUP BY ALL),
walk AS (
  SELECT run, n, CAST(1 AS BIGINT) AS a FROM han
  UNION ALL
  SELECT w.run, w.n, w.a + coalesce(b.k, 1) FROM walk w LEFT JOIN best b ON b.run = w.run AND b.a = w.a
  WHERE w.a + coalesce(b.k, 1) <= length(w.run)
),
terms AS (
  SELECT substr(w.run, w.a, coalesce(b.k, 1)) AS word, n FROM walk w LEFT JOIN best b ON b.run = w.run AND b.a = w.a
  UNION ALL SELECT run, n FROM runs WHERE NOT regexp_matches(run, '^\\p{{Han}}')
)
SELECT word, CAST(sum(n) AS BIGINT) AS cnt FROM terms GROUP BY word HAVING sum(n) >= 10""",
    "hot_words": f"""WITH {MESSAGES_SQL}
SELECT bucket_ms, word, count(*) AS cnt FROM toks GROUP BY bucket_ms, word HAVING count(*) >= 10""",
    "hot_words_two_level": f"""WITH {MESSAGES_SQL},
win AS (
  SELECT (arrival_sec - arrival_sec % 300) * 1000 AS win_ms, bucket_ms, word, count(*) AS n
  FROM toks GROUP BY 1, 2, 3 HAVING count(*) >= 10
)
SELECT strftime(DATE '1970-01-01' + CAST(win_ms // 86400000 AS INTEGER), '%Y%m%d') AS day,
       bucket_ms, word, CAST(sum(n) AS BIGINT) AS cnt
FROM win GROUP BY 1, 2, 3""",
    "hot_words_blacklist": f"""WITH {MESSAGES_SQL}
SELECT bucket_ms, word, count(*) AS cnt FROM toks_bl GROUP BY bucket_ms, word""",
    "sentiment_by_item": f"""WITH {MESSAGES_SQL}
SELECT bucket_ms, av, {POLARITY_SQL} AS emotion, count(*) AS cnt FROM terms GROUP BY 1, 2, 3""",
    "sentiment_by_bucket_first_item": f"""WITH {MESSAGES_SQL}
SELECT bucket_ms, {POLARITY_SQL} AS emotion, count(*) AS cnt, arg_min(av, seq) AS first_av
FROM toks_bl GROUP BY 1, 2""",
    "running_word_count": f"""WITH {MESSAGES_SQL}, {RUNNING_SQL}
SELECT bucket_ms, word, seq, pos, running_cnt FROM running""",
    "count_window_batches": f"""WITH {MESSAGES_SQL}, {RUNNING_SQL},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY seq, pos) AS rn, count(*) OVER () AS total FROM running
)
SELECT CAST((rn - 1) // 200 AS BIGINT) AS window_no, bucket_ms, word, seq, pos, running_cnt
FROM numbered WHERE (rn - 1) // 200 < total // 200 AND running_cnt > 10""",
    "clean_text": f"""WITH {MESSAGES_SQL}
SELECT seq, origin,
       regexp_replace(text, '[\\pP\\pS\\pZ]', '', 'g') AS cleaned,
       regexp_replace(regexp_replace(text, '[\\pP\\pS\\pZ]', '', 'g'), '[a-zA-Z]', '', 'g') AS cleaned_no_latin
FROM kept""",
    "document_hot_words_by_lang": """WITH t AS (
  SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word FROM documents
)
SELECT lang, word, count(*) AS cnt FROM t WHERE length(word) >= 2 GROUP BY lang, word HAVING count(*) >= 10""",
}
