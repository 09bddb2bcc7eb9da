"""Queries over document statistics (p9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm.quality import classify, train
from codestrata.llm.text_stats import basic_statistics
from codestrata.plans.tables import table


def p9_forms(spark, sf_dir):
    docs, words = table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")
    return classify(docs, train(docs, words))


def p9_found(spark, sf_dir):
    return p9_forms(spark, sf_dir).where(F.col("form") != "prose").select("doc_id", "form").distinct()


def p9_statistics(spark, sf_dir):
    return basic_statistics(table(spark, sf_dir, "documents"), "text", table(spark, sf_dir, "common_words"), ["doc_id"])


QUERIES = {"p9_found": p9_found, "p9_forms": p9_forms, "p9_statistics": p9_statistics}

SQL = {
    "p9_statistics": r"""WITH c AS (SELECT list(DISTINCT lower(word)) AS listed FROM common_words WHERE word IS NOT NULL),
d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{L}+') AS w, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, length(text) AS n_chars_real, len(w) AS n_words, len(l) AS n_lines, length(array_to_string(w, '')) AS letters,
  length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) AS symbols,
  len(list_filter(l, lambda x: regexp_matches(trim(x), '[.!?:;]$'))) AS ends, len(list_filter(w, lambda x: list_contains(listed, x))) AS common FROM d, c)
SELECT doc_id, n_chars_real, n_words, n_lines,
  CASE WHEN n_words > 0 THEN round(letters / n_words, 6) ELSE 0.0 END AS mean_word_length,
  CASE WHEN n_chars_real > 0 THEN round(symbols / n_chars_real, 6) ELSE 0.0 END AS symbol_ratio,
  CASE WHEN n_lines > 0 THEN round(ends / n_lines, 6) ELSE 0.0 END AS punctuated_lines,
  CASE WHEN n_words > 0 THEN round(common / n_words, 6) ELSE 0.0 END AS common_word_share
FROM n""",
}
