"""The queries of this folder by name, and the SQL that must agree where SQL can say it."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, html_text, language, mixing, pseudonyms, quality, simhash, substrings, toxicity, url_filter
from .common import table


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark, sf_dir):
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op5_quality_rules(spark, sf_dir):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(*cols)


def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


def op8_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).drop("copies")


def op9_pseudonyms(spark, sf_dir):
    return pseudonyms.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op10_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")} | {"pipeline": corpus_pipeline.run}

#: Words are parted by ASCII white space: the pattern stands for a run of it.
_PLAIN = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS l FROM d)"""

SQL: dict[str, str] = {
    "op5_quality_rules": _PLAIN + """,
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 20 * n_symbols > word_chars OR 2 * n_dup_lines > n_lines OR 2 * n_upper > word_chars AS failed FROM b),
h AS (SELECT source, count(*) AS n, sum(failed::INT) AS f FROM f GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS sq, count(*) AS k, sum(n) AS n FROM h),
c AS (SELECT mean, mean * (1 - mean) AS chance, greatest(sq - mean * mean - mean * (1 - mean) * k / n, 1e-6) AS spread FROM a),
p AS (SELECT mean, least(greatest(chance / spread - 1, 1.0), 1000.0) AS weight FROM c),
v AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AND (NOT failed OR rate < 0.02) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
    "op10_decontaminate": """
WITH x AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM x),
s AS (SELECT DISTINCT kind, id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n)::BIGINT AS n_item, count(*) / any_value(n.n) AS containment
FROM s AS i JOIN s AS d ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9
""",
}
