"""The corpus operators' queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import exact_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity
from weirflow.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), width=35).drop("kept_text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_earlier(table(spark, sf_dir, "documents"), width=50).drop("kept_bytes")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_token_counts": op7_token_counts,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_quality_classifier": op10_quality_classifier,
    }


OP2_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, length(coalesce(text, '')) AS code_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER own AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER own AS kept,
       text_sha256
FROM rows_
WINDOW own AS (PARTITION BY text_sha256 ORDER BY code_points DESC, doc_id)
"""


_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingle FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(shingle) AS size FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
e AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n m ON m.doc_id = a.doc_id JOIN n k ON k.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(m.size) + any_value(k.size) - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, any_value(size) AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY 1
"""

OP3_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS words FROM documents),
v AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, sha256(array_to_string(words[i:i + 34], ' ')) AS s FROM w WHERE len(words) >= 35),
g AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT doc_id, i FROM v WHERE s IN (SELECT s FROM v GROUP BY s HAVING count(*) > 1)), range(35) t(k)),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM u ANTI JOIN g USING (doc_id, place) GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP4_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS s FROM d WHERE len(words) >= 8),
c AS (SELECT doc_id, count(DISTINCT i + k) AS repeats FROM (SELECT doc_id, i FROM g WHERE (doc_id, s) IN (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1)), range(8) t(k) GROUP BY 1),
m AS MATERIALIZED (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS dup, len(lines) AS lines, coalesce(repeats, 0) AS repeats, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]')) AS marks
  FROM d LEFT JOIN c USING (doc_id)),
v AS MATERIALIZED (SELECT doc_id, n < 20 OR 100 * repeats > 30 * n AS failed, CASE WHEN n < 100 THEN 0 WHEN n < 400 THEN 1 ELSE 2 END AS stratum, u.rule, u.value FROM m, LATERAL (VALUES
  ('symbols', symbols / n), ('repeats', repeats / n), ('lines', dup / lines), ('capitals', upper / chars), ('marks', marks / chars), ('word_length', chars / n / 20)) u(rule, value)),
l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
x AS (SELECT stratum, rule, quality, CASE WHEN value > 0 THEN least(32, greatest(-1, ceil(4 * log2(value * 64)) - 1)) ELSE -1 END AS rung FROM v JOIN l USING (doc_id) WHERE NOT failed),
h AS (SELECT b.stratum, b.rule, r.rung, (SELECT count(*) FROM x WHERE x.stratum = b.stratum AND x.rule = b.rule AND quality = 1) AS n, (SELECT count(*) FROM x WHERE x.stratum = b.stratum AND x.rule = b.rule AND quality = 1 AND x.rung >= r.rung) AS k,
  (SELECT count(*) FROM x WHERE x.stratum = b.stratum AND x.rule = b.rule AND quality = 0 AND x.rung >= r.rung) AS hits FROM (SELECT DISTINCT stratum, rule FROM x) b, range(33) r(rung)),
t AS (SELECT *, CASE WHEN k > n * (0.02 / 6) THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / 6) + (n - i) * ln(1 - 0.02 / 6)))) END AS tail FROM h),
y AS (SELECT *, sum(CAST(tail > 0.05 / 18 AS INT)) OVER (PARTITION BY stratum, rule ORDER BY rung DESC) AS stops FROM t),
z AS (SELECT stratum, rule, arg_max(rung, (hits - 100.0 * k, rung)) AS rung FROM y WHERE stops = 0 AND hits > 0 AND hits > 100.0 * k GROUP BY 1, 2),
o AS (SELECT DISTINCT doc_id FROM v JOIN z USING (stratum, rule) WHERE value > pow(2.0, rung / 4.0) / 64.0)
SELECT m.doc_id, n AS n_words, chars AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, repeats AS n_repeat_words, n < 20 OR 100 * repeats > 30 * n AS base_failed,
  NOT (n < 20 OR 100 * repeats > 30 * n) AND m.doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM m
"""

OP5_SQL = """
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS MATERIALIZED (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM b WHERE length(h) >= 100),
f AS (SELECT s, min(doc_id) AS first FROM v GROUP BY s HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i, i + 50 AS till, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v JOIN f USING (s) WHERE first < doc_id),
q AS (SELECT doc_id, i, till, sum(CAST(upto IS NULL OR i > upto AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
z AS (SELECT doc_id, min(i) AS a, max(till) AS z FROM q GROUP BY doc_id, run),
x AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM z),
k AS (SELECT x.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept FROM x JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op5_suffix_dedup": OP5_SQL}
