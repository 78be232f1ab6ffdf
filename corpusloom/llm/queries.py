"""The queries of the text operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.presence import sized_broadcast
from . import bpe, decontaminate, jaccard_join, langid, masked_lm, quality_model, quality_rules, secrets, simhash, suffix_dedup, token_rollup, vector_codes
from .common import shared_dir, table


def bucket(key, n: int):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), lambda k: bucket(k, 5) != 0)
    out = quality_model.classify(docs, model)
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(bucket(F.col("doc_id"), 4) != 2), "text", "lang", "doc_id")
    out = langid.identify(docs, profiles)
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark, sf_dir):
    return secrets.detect(table(spark, sf_dir, "documents")).drop("found")


def op5_decontamination(spark, sf_dir):
    return decontaminate.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark, sf_dir):
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM w)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
repeated AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(0, 5) r(k) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
tops AS (SELECT rid, max(c) AS c FROM (SELECT rid, x, count(*) AS c FROM (SELECT rid, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY rid),
base AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(t) - length(replace(t, '!', '')) AS marks, coalesce(l.n, 0) AS n_lines, coalesce(c, 0) AS top_word, length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS uppers
  FROM w LEFT JOIN repeated r USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN tops USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.6 * n_words OR marks > 0.6 * n_words OR NOT (1.2 * n_words <= word_chars AND word_chars <= 40 * n_words)
  OR (n_lines >= 6 AND n_dup_lines > 0.6 * n_lines) OR (n_words >= 20 AND top_word > 0.5 * n_words) OR (letters >= 40 AND uppers > 0.7 * letters)) AS kept FROM judged
"""


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_token_rollup(spark, sf_dir):
    """All documents are inserted, those labelled bad are deleted, and those labelled toxic (and not bad) are revised: a
    review mark is put at their end.  The delete batch is sent twice and counts once.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = token_rollup.TokenLedger(spark, f"{shared_dir(spark).rstrip('/')}/loom-tokens-{uuid.uuid4().hex}")
    ledger.apply("insert", token_rollup.events("insert", token_rollup.counted(docs, F.col("text"))))
    bad = labels.where("quality = 0").select("doc_id").distinct()
    toxic = labels.where("toxic = 1").select("doc_id").distinct().join(bad, "doc_id", "left_anti")
    ledger.apply("delete", token_rollup.deletes(bad))
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit(" [reviewed]"))
    ledger.apply("revise", token_rollup.events("revise", token_rollup.counted(docs.join(sized_broadcast(toxic), "doc_id", "left_semi"), marked)))
    ledger.apply("delete", token_rollup.deletes(bad))
    ledger.compact()
    return ledger.totals()


OP8_SQL = r"""
WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
present AS (
  SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL) THEN coalesce(text, '') || ' [reviewed]' ELSE coalesce(text, '') END AS t
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = d.doc_id)),
counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM present
  UNION ALL
  SELECT source, lang, 'pieces-2', len(regexp_extract_all(t, '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) FROM present)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY ALL
"""


def op9_masked_lm(spark, sf_dir):
    return masked_lm.fit_and_score(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT rid, count(*) AS n FROM sets GROUP BY rid),
links AS (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.rid <> y.rid GROUP BY ALL)
  JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (rid) JOIN reach USING (rid) JOIN d o ON o.rid = reach.other GROUP BY d.rid, d.doc_id, n
"""


def op12_vector_codes(spark, sf_dir):
    out, book, _ = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return out.withColumn("codebooks_sha256", F.lit(book.digest() if book else None).cast("string"))


def _book_sql(old: str, coded: str) -> str:
    """Entries after a round, by SQL: floors of the means of the parts coded with them, others as before."""
    return f"""(
  SELECT o.p, o.e, coalesce(u.c, o.c) AS c FROM {old} o LEFT JOIN (
    SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c
    FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {coded}) GROUP BY ALL) GROUP BY p, e) u
  ON u.p = o.p AND u.e = o.e)"""


def _code_sql(book: str) -> str:
    """Each part with its nearest entry of a book, ties to the lower index."""
    return f"""(
  SELECT rid, p, any_value(x) AS x, min({{'d': d, 'e': e}}).e AS e, min({{'d': d, 'e': e}}).d AS d
  FROM (SELECT rid, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN {book} b ON b.p = parts.p)
  GROUP BY rid, p)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
b0 AS (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 64),
a0 AS {_code_sql("b0")},
b1 AS {_book_sql("b0", "a0")},
a1 AS {_code_sql("b1")},
b2 AS {_book_sql("b1", "a1")},
a2 AS {_code_sql("b2")},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""


QUERIES = {q.__name__: q for q in (op1_quality_classifier, op2_bpe, op3_language_id, op4_secret_scan, op5_decontamination, op6_quality_rules, op7_suffix_dedup, op8_token_rollup, op9_masked_lm, op10_simhash, op11_jaccard_join, op12_vector_codes)}
SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op8_token_rollup": OP8_SQL, "op11_jaccard_join": OP11_SQL, "op12_vector_codes": OP12_SQL}
