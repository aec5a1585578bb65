"""The registered queries of the operators: each over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, decontaminate, lexical, licenses, lm_score, near_dedup, quality, resample, sentencepiece_codec, simhash, substring_dedup, token_count, toxicity

#: Vocabulary files of public tokenizers.
RANKS, PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.stupid_backoff(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 5).alias("log_score"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.tiled_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_covered", "n_tiles")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), RANKS)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(_table(spark, sf_dir, "documents"), PIECES)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    found = licenses.scan(_table(spark, sf_dir, "documents"), path)
    return found.select("doc_id", "path", "license", "origin", F.round("cosine", 6).alias("cosine"), "from_dir")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_quality": op6_quality,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_simhash": op11_simhash,
    "op12_lexical_search": op12_lexical_search,
    "op13_importance_resampling": op13_importance_resampling,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_lm_score": f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents)),
g AS (SELECT doc_id, i, w1, lag(w1) OVER d AS w2, lag(w1, 2) OVER d AS w3 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w1, count(*) AS n1 FROM g GROUP BY 1),
c2 AS (SELECT w2, w1, count(*) AS n2 FROM g WHERE i >= 2 GROUP BY 1, 2),
c3 AS (SELECT w3, w2, w1, count(*) AS n3 FROM g WHERE i >= 3 GROUP BY 1, 2, 3),
s AS (
  SELECT g.doc_id, CASE
    WHEN g.i >= 3 AND c3.n3 >= 2 THEN ln(c3.n3 / CAST(before.n2 AS DOUBLE))
    WHEN g.i >= 2 AND c2.n2 >= 2 THEN ln(c2.n2 / CAST(one.n1 AS DOUBLE)) + (least(g.i, 3) - 2) * ln(CAST(0.4 AS DOUBLE))
    ELSE ln(c1.n1 / CAST((SELECT count(*) FROM w) AS DOUBLE)) + (least(g.i, 3) - 1) * ln(CAST(0.4 AS DOUBLE)) END AS score
  FROM g JOIN c1 ON c1.w1 = g.w1 LEFT JOIN c1 AS one ON one.w1 = g.w2 LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w1 = g.w1
  LEFT JOIN c2 AS before ON before.w2 = g.w3 AND before.w1 = g.w2 LEFT JOIN c3 ON c3.w3 = g.w3 AND c3.w2 = g.w2 AND c3.w1 = g.w1)
SELECT d.doc_id, count(s.score) AS n_words, round(coalesce(sum(s.score), 0), 5) AS log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op2_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, min(a.n) AS na, min(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT k.b, reach.r FROM reach JOIN both_ways k ON k.a = reach.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id""",
    "op4_token_counts": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w FROM d),
p AS (SELECT DISTINCT hex(from_base64(split_part(line, ' ', 1))) AS piece
      FROM read_csv('{RANKS}', columns = {{'line': 'VARCHAR'}}, header = false, delim = '\x01', quote = '', escape = '', auto_detect = false) WHERE line <> ''),
longest AS (SELECT max(length(piece)) AS most FROM p),
r(w, rest, n) AS (
  SELECT w, hex(' ' || w), 0 FROM (SELECT DISTINCT w FROM t)
  UNION ALL
  SELECT w, substr(rest, max(length(piece)) + 1), n + 1
  FROM (SELECT w, rest, n, unnest(range(2, least(length(rest), most) + 1, 2)) AS k FROM r, longest WHERE rest <> '') s JOIN p ON p.piece = substr(s.rest, 1, s.k)
  GROUP BY w, rest, n),
c AS (SELECT w, coalesce(max(n) FILTER (WHERE rest = ''), 1) AS n FROM r GROUP BY w),
m AS (SELECT doc_id, sum(n) AS n FROM t JOIN c ON c.w = t.w GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_tokens FROM d LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) r(i)),
o AS (SELECT win, min(doc_id) AS owner FROM v GROUP BY win),
f AS (SELECT v.doc_id, v.i FROM v JOIN o ON o.win = v.win WHERE owner < v.doc_id),
m AS (
  SELECT t.doc_id, t.i, t.word, max(CASE WHEN f.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.i = t.i)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, count(m.i) FILTER (WHERE gone = 1) AS n_removed,
       sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.i) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN m ON m.doc_id = w.doc_id GROUP BY w.doc_id, w.ws""",
    "op12_lexical_search": f"""
WITH d AS (SELECT doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
a AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
t AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), a),
v AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)) AS v FROM t, a WHERE term IN (SELECT term FROM q)),
s AS (SELECT item_id, doc_id, CAST(sum(w * v) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN v USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_importance_resampling": f"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) t(b))),
d AS (SELECT doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS word FROM d),
g AS (SELECT unnest(coalesce({_TERMS}, [])) AS word FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM f UNION SELECT word FROM g)),
b AS (
  SELECT word, xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, len(h), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1 AS UBIGINT))),
    lambda c, x: xor(c >> 8, crcs[CAST(xor(c & 255, x) AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM f JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM g JOIN b USING (word) GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM f) AS all_s, (SELECT count(*) FROM g) AS all_t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), a),
w AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN b USING (word) JOIN gain USING (bucket) GROUP BY 1),
h AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('2024:' || doc_id)[i]) - 1) * (CAST(1 AS BIGINT) << CAST(32 - 4 * i AS BIGINT)))) AS h
  FROM d LEFT JOIN w USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT x.*, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)""",
}
