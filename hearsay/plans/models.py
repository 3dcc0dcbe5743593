"""Registered queries: model hooks, valence scores, vectors and text pairs.

No trained model is at hand, so the hooks are run with small fixed functions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.vocab import NAMESPACE_URL, NEGATIONS
from hearsay.operators import models, pairs, valence, vectors
from hearsay.plans.inputs import POSTS, posts, sql_list, table
from hearsay.plans.registry import add


def _stand_ins():
    """A scorer, a classifier and an encoder. They are made inside a function so that they
    travel to the workers by value: this module need not be installed there."""

    def vowel_share():
        """The share of the letter e."""
        return lambda texts: [text.count("e") / max(len(text), 1) for text in texts]

    def letter_contest():
        """Which of a and e is more frequent, and by how much."""

        def judge(text):
            a, e = text.count("a"), text.count("e")
            label = "POSITIVE" if a > e else "NEGATIVE" if e > a else "NEUTRAL"
            return label, abs(a - e) / max(a + e, 1)

        return lambda texts: [judge(text) for text in texts]

    def letter_counts():
        """How often each letter stands in the text."""
        letters = "abcdefghijklmnopqrstuvwxyz"
        return lambda texts: [[float(text.count(c)) for c in letters] for text in texts]

    return vowel_share, letter_contest, letter_counts


vowel_share, letter_contest, letter_counts = _stand_ins()


def _uses(letter: str) -> str:
    return f"(length(text) - length(replace(text, '{letter}', '')))"


add("model_scores", "X3 X4",
    lambda s, d: models.score_with(
        posts(s, d).select("post_id", "text"), "text", vowel_share).drop("text"), f"""
WITH {POSTS}
SELECT post_id, round({_uses('e')}::DOUBLE / greatest(length(text), 1), 6) AS score FROM posts""")

add("model_labels", "X5",
    lambda s, d: models.classify_with(
        posts(s, d).select("post_id", "text"), "text", letter_contest).drop("text"), f"""
WITH {POSTS}, n AS (SELECT post_id, {_uses('a')}::DOUBLE AS a, {_uses('e')}::DOUBLE AS e FROM posts)
SELECT post_id, round((a - e) / greatest(a + e, 1), 6) AS sentiment_score FROM n""")

_LETTERS = "".join(f"({i}, '{c}'), " for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"))[:-2]

_EMBEDDED = f"""{POSTS}, n AS (
  SELECT post_id, pos, (length(text) - length(replace(text, letter, '')))::DOUBLE AS n
  FROM posts, (VALUES {_LETTERS}) l(pos, letter)),
vectors AS (
  SELECT post_id, pos, coalesce(n / nullif(sqrt(sum(n * n) OVER (PARTITION BY post_id)), 0), 0) AS x
  FROM n)"""


def _embedded(s, d) -> DataFrame:
    return models.embed(posts(s, d), "text", letter_counts)


add("embedded_texts", "V1",
    lambda s, d: _embedded(s, d).select("post_id", F.posexplode("vector").alias("pos", "x")), f"""
WITH {_EMBEDDED}
SELECT post_id, pos::BIGINT AS pos, round(x::FLOAT::DOUBLE, 6) AS x FROM vectors""")

# Valence ------------------------------------------------------------------------------------


def lexicon(s, d) -> DataFrame:
    """Words of the benchmark texts with a made-up valence from -4 to 4."""
    words = table(s, d, "benchmark").select(F.explode(valence.valence_words("text")).alias("word"))
    return words.distinct().select("word", (F.ascii("word") % 9 - 4).cast("double").alias("valence"))


def list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


_LEXICON = """lexicon AS (
  SELECT DISTINCT word, (ascii(word) % 9 - 4)::DOUBLE AS valence FROM (
    SELECT unnest(regexp_extract_all(replace(lower(text), chr(39), ''), '\\p{L}+')) AS word
    FROM benchmark))"""

# Words are marked only where the lexicon has them.
_VALENCE = f"""WITH {POSTS}, {_LEXICON},
split AS (
  SELECT post_id, regexp_extract_all(replace(lower(text), chr(39), ''), '\\p{{L}}+') AS words
  FROM posts),
placed AS (
  SELECT post_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
turned AS (
  SELECT DISTINCT post_id, i + k AS i FROM placed, range(1, 4) t(k)
  WHERE word IN {sql_list(NEGATIONS)}),
marked AS (
  SELECT p.post_id, p.word, t.i IS NOT NULL AS negated
  FROM placed p JOIN lexicon USING (word) LEFT JOIN turned t ON t.post_id = p.post_id AND t.i = p.i),
totals AS (
  SELECT post_id, sum(valence * CASE WHEN negated THEN -0.74::DOUBLE ELSE 1 END) AS total
  FROM marked JOIN lexicon USING (word) GROUP BY 1)
SELECT post_id, CASE WHEN total IS NULL THEN 0.0::DOUBLE ELSE
       round(greatest(-1, least(1, total / sqrt(total * total + 15))), 6) END AS score
FROM posts LEFT JOIN totals USING (post_id)"""

add("valence_scores", "F16 X3 J10",
    lambda s, d: valence.valence_score(
        posts(s, d).select("post_id", "text"), "text", lexicon(s, d), "post_id").drop("text"),
    _VALENCE)

# The same with every lexicon word listed twice, its valences as far above as below.
add("valence_scores_joined", "F16 J10",
    lambda s, d: valence.valence_score(
        posts(s, d).select("post_id", "text"), "text",
        lexicon(s, d).select("word", F.explode(F.array(
            F.col("valence") - 1, F.col("valence") + 1, F.lit(None))).alias("valence")),
        "post_id").drop("text"), _VALENCE)

# The rules of context, with common words of the generated texts in the place of very, not and but,
# and marks added to the texts.
_RULES = valence.ContextWords(
    up=["the", "la", "thatin"], down=["de", "of"], negations=["in", "der", "it"], contrast="and")


def _marked_posts(s, d) -> DataFrame:
    marks = F.concat(F.repeat(F.lit("!"), F.col("post_id").cast("int") % 6),
                     F.repeat(F.lit("?"), F.col("post_id").cast("int") % 5))
    loud = F.when(F.col("post_id") % 3 == 0, F.regexp_replace("text", "re", "RE")).otherwise(F.col("text"))
    return posts(s, d).select("post_id", F.concat(loud, marks).alias("text"))


def _step(k: int) -> str:
    """The SQL of what the k-th word before another one does to its valence."""
    w, plain = f"before{k}", f"replace(lower(before{k}), chr(39), '')"
    shout = f"(upper({w}) = {w} AND lower({w}) <> {w})"
    degree = (f"CASE WHEN {plain} IN {sql_list(_RULES.up)} THEN 0.293::DOUBLE "
              f"WHEN {plain} IN {sql_list(_RULES.down)} THEN -0.293 ELSE 0 END")
    louder = (f"CASE WHEN {degree} <> 0 AND shouted AND {shout} THEN CASE WHEN v{k - 1} > 0 "
              "THEN 0.733::DOUBLE ELSE -0.733 END ELSE 0 END")
    sign = f"CASE WHEN v{k - 1} < 0 THEN -1 ELSE 1 END"
    return (
        f"stepped{k} AS (SELECT *, CASE WHEN {w} IS NULL "
        f"THEN v{k - 1} ELSE (v{k - 1} + (({degree}) * ({sign}) + {louder}) * {(1.0, 0.95, 0.9)[k - 1]}) "
        f"* CASE WHEN {plain} IN {sql_list(_RULES.negations)} OR contains({w}, 'n''t') THEN -0.74::DOUBLE "
        f"ELSE 1 END END AS v{k} FROM {'hits' if k == 1 else f'stepped{k - 1}'})"
    )


_CONTEXT = f"""WITH {POSTS}, {_LEXICON},
marked AS (
  SELECT post_id, CASE WHEN post_id % 3 = 0 THEN replace(text, 're', 'RE') ELSE text END
         || repeat('!', (post_id % 6)::INT) || repeat('?', (post_id % 5)::INT) AS text FROM posts),
split AS MATERIALIZED (
  SELECT post_id, text, list_filter(list_transform(
           string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'),
           lambda w: CASE WHEN length(trim(w, '{valence.PUNCTUATION.replace("'", "''")}')) <= 2 THEN w
                          ELSE trim(w, '{valence.PUNCTUATION.replace("'", "''")}') END),
         lambda w: w <> '') AS words FROM marked),
loud AS MATERIALIZED (
  SELECT post_id, len(words) AS n_words,
         len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w)) AS n_loud,
         coalesce(list_position(list_transform(words, lambda w: lower(w)), '{_RULES.contrast}'), 0)
           AS contrast FROM split),
placed AS MATERIALIZED (
  SELECT post_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
free AS MATERIALIZED (SELECT p.* FROM placed p ANTI JOIN lexicon l ON l.word = lower(p.word)),
hits AS (
  SELECT f.post_id, f.place, f.word, n_loud > 0 AND n_loud < n_words AS shouted, contrast,
         a.word AS before1, b.word AS before2, c.word AS before3,
         valence + CASE WHEN n_loud > 0 AND n_loud < n_words AND upper(f.word) = f.word
                             AND lower(f.word) <> f.word
              THEN CASE WHEN valence > 0 THEN 0.733::DOUBLE ELSE -0.733 END ELSE 0 END AS v0
  FROM placed f JOIN lexicon l ON l.word = lower(f.word) JOIN loud USING (post_id)
  LEFT JOIN free a ON a.post_id = f.post_id AND a.place = f.place - 1
  LEFT JOIN free b ON b.post_id = f.post_id AND b.place = f.place - 2
  LEFT JOIN free c ON c.post_id = f.post_id AND c.place = f.place - 3),
{_step(1)},
{_step(2)},
{_step(3)},
totals AS (
  SELECT post_id, sum(CASE WHEN lower(word) IN {sql_list([*_RULES.up, *_RULES.down])} THEN 0
           ELSE v3 * CASE WHEN contrast = 0 OR place = contrast THEN 1
                          WHEN place < contrast THEN 0.5::DOUBLE ELSE 1.5 END END) AS total
  FROM stepped3 GROUP BY 1),
sums AS (
  SELECT post_id, coalesce(total, 0) AS total,
         least(4, length(text) - length(replace(text, '!', ''))) * 0.292::DOUBLE
         + CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0
                WHEN length(text) - length(replace(text, '?', '')) <= 3
                THEN (length(text) - length(replace(text, '?', ''))) * 0.18::DOUBLE
                ELSE 0.96 END AS marks
  FROM marked LEFT JOIN totals USING (post_id)),
whole AS (SELECT post_id, total + sign(total) * marks AS x FROM sums)
SELECT post_id, round(greatest(-1, least(1, x / sqrt(x * x + 15))), 6) AS score FROM whole"""

add("valence_in_context", "F16 X3",
    lambda s, d: valence.valence_in_context(
        _marked_posts(s, d), "text", lexicon(s, d), "post_id", words=_RULES).drop("text"),
    _CONTEXT)

# Vectors ------------------------------------------------------------------------------------


def centroids(s, d) -> DataFrame:
    """Mean vector per label: the queries."""
    parts = table(s, d, "embeddings").select(
        F.col("label").alias("query_id"), F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("query_id", "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("query_id").agg(
        F.transform(ordered, lambda point: point["x"]).alias("embedding"))


_NEAREST = """centroids AS (
  SELECT label AS query_id, list(x ORDER BY pos) AS q FROM (
    SELECT label, pos, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1),
scored AS (
  SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score
  FROM centroids CROSS JOIN embeddings),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn
  FROM scored)"""


def _nearest(s, d, k: int, **options) -> DataFrame:
    return vectors.nearest(table(s, d, "embeddings"), centroids(s, d), k, **options)


add("nearest_vectors", "V2", lambda s, d: _nearest(s, d, 10), f"""
WITH {_NEAREST}
SELECT query_id::BIGINT AS query_id, vec_id, round(score, 6) AS score, rn FROM found WHERE rn <= 10""")

add("nearest_vectors_blocked", "V2",
    lambda s, d: _nearest(s, d, 10, block_rows=40), f"""
WITH {_NEAREST}
SELECT query_id::BIGINT AS query_id, vec_id, round(score, 6) AS score, rn FROM found WHERE rn <= 10""")


def _texts(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")


add("retrieved_texts", "V3 P16 F33",
    lambda s, d: vectors.retrieve_texts(
        _nearest(s, d, 50), _texts(s, d), "vec_id", "text", min_length=400).select(
        "query_id", "vec_id", "rn", "place", F.md5("text").alias("digest")), f"""
WITH {_NEAREST}, kept AS (
  SELECT f.*, trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM found f JOIN documents d ON d.doc_id = f.vec_id WHERE rn <= 50),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
  FROM kept WHERE length(text) >= 400)
SELECT query_id::BIGINT AS query_id, vec_id, rn, place, md5(text) AS digest FROM placed
WHERE place <= 5""")

add("vector_points", "V4 F30 P25",
    lambda s, d: vectors.points(
        posts(s, d).join(
            table(s, d, "embeddings").withColumnRenamed("vec_id", "post_id"), "post_id"
        ).withColumn("cid", F.concat("source", F.lit("/"), "post_id")),
        NAMESPACE_URL, "text", "cid", "embedding", ["post_id", "did", "source", "text"]).select(
        "id", F.size("vector").alias("dims"), F.get("vector", 0).cast("double").alias("x0"),
        "payload.post_id", "payload.did", F.md5("payload.text").alias("digest")), f"""
WITH {POSTS}, h AS (
  SELECT p.*, v.embedding, sha1(from_hex('{uuid.UUID(NAMESPACE_URL).hex}')
         || encode(source || '/' || post_id)) AS h
  FROM posts p JOIN embeddings v ON v.vec_id = p.post_id)
SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-'
       || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-'
       || h[21:32] AS id, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) AS x0,
       post_id, did, md5(text) AS digest FROM h""")

# Pairs --------------------------------------------------------------------------------------

_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS post_text, b.text AS comment_text
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""


def _turn_pairs(s, d) -> DataFrame:
    return pairs.turn_pairs(table(s, d, "conversations"), "conv_id", "turn", "text", "role")


add("turn_pairs", "J11",
    lambda s, d: _turn_pairs(s, d).select(
        "conv_id", "turn", F.md5("post_text").alias("post"), F.md5("comment_text").alias("reply")),
    f"""
WITH {_PAIRS}
SELECT conv_id, turn, md5(post_text) AS post, md5(comment_text) AS reply FROM pairs""")


def threads(s, d) -> DataFrame:
    """Each user turn as a post, the answer as its reply; some carry images."""
    def record(text: str, images):
        return F.struct(
            F.col(text).alias("text"),
            F.struct(F.when(images, F.array(F.struct(F.lit("x").alias("alt")))).alias("images"))
            .alias("embed"))

    replies = F.array(
        F.struct(F.struct(record("comment_text", F.col("turn") >= 4).alias("record")).alias("post")))
    post = F.struct(record("post_text", F.length("post_text") % 5 == 0).alias("record"))
    return _turn_pairs(s, d).select(F.struct(post.alias("post"), replies.alias("replies")).alias(
        "thread"))


add("reply_pairs", "J11",
    lambda s, d: pairs.reply_pairs(threads(s, d)).select(
        F.md5("post_text").alias("post"), F.md5("comment_text").alias("reply")), f"""
WITH {_PAIRS} SELECT md5(post_text) AS post, md5(comment_text) AS reply FROM pairs""")

add("training_pairs", "V5 P16 P17",
    lambda s, d: pairs.training_pairs(pairs.reply_pairs(threads(s, d)), 100).select(
        F.md5("post_text").alias("post"), F.md5("comment_text").alias("reply")), f"""
WITH {_PAIRS}
SELECT md5(post_text) AS post, md5(comment_text) AS reply FROM pairs
WHERE length(post_text) > 100 AND length(comment_text) > 100 AND turn < 4
      AND length(post_text) % 5 <> 0""")
