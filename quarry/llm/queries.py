"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, html_text, importance, langid, lexical, line_dedup, mixing, ngram_join, packing, pitman_yor, quality_rules, snapshot, token_files
from .common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op4_fair_queue_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_pitman_yor_scoring(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_anisotropic_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_snapshot_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return snapshot.difference(docs, snapshot.later_documents(docs), "doc_id", ["text", "lang", "source"])


def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_best_fit_packing, op3_line_dedup, op4_fair_queue_mixing, op5_token_files, op6_importance_resampling, op7_language_id, op8_pitman_yor_scoring, op9_quality_rules, op10_anisotropic_ann, op11_html_extraction, op12_snapshot_difference, op13_lexical_search)}
_WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

_CONTENT = "md5(concat(coalesce(upper(md5(text)), '~'), coalesce(upper(md5(lang)), '~'), coalesce(upper(md5(source)), '~')))"
#: crc32 of the decimal doc_id: four bits at a time, by the 16 remainders of the reflected polynomial 0xEDB88320.
_STEPS = [0]
for _n in range(1, 16):
    _c = _n
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _STEPS.append(_c)
_HALF = "xor(({c}) >> 4, [" + ", ".join(f"{c}::BIGINT" for c in _STEPS) + "][(({c}) & 15) + 1])"
_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda a, b: "
    + _HALF.format(c=_HALF.format(c="xor(a, b)")) + "))"
)

ORACLE = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), units AS (
  SELECT *, {_WORDS.format('line')} AS words, sum(CAST({_WORDS.format('line')} > 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM lines
), heads AS (
  SELECT doc_id, unit, line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY unit) AS upto FROM units WHERE words > 0
), whole AS (SELECT doc_id, list(line ORDER BY unit) AS content FROM heads GROUP BY doc_id
), runs AS (
  SELECT a.doc_id, a.unit AS first, b.unit AS last, md5(array_to_string(list_slice(content, CAST(a.unit AS BIGINT), CAST(b.unit AS BIGINT)), chr(10))) AS run
  FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.unit BETWEEN a.unit AND a.unit + 9 JOIN whole ON a.doc_id = whole.doc_id
  WHERE b.upto - a.upto + a.words >= 10 AND b.upto - a.upto + a.words - greatest(a.words, b.words) < 10
), later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS n FROM runs) WHERE n > 1
  UNION ALL
  SELECT doc_id, unit, unit FROM (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, unit) AS n, count(*) OVER (PARTITION BY line) AS places FROM heads
  ) WHERE n > 1 AND words >= 5 AND places >= 50
), gone AS (SELECT DISTINCT doc_id, unnest(range(CAST(first AS BIGINT), CAST(last AS BIGINT) + 1)) AS unit FROM later
), kept AS (
  SELECT u.doc_id, max(u.unit) AS n_lines, count(DISTINCT g.unit) AS n_removed,
    coalesce(string_agg(u.line, chr(10) ORDER BY pos) FILTER (WHERE g.unit IS NULL), '') AS text
  FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.unit = g.unit GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(k.text) AS BIGINT) AS kept_chars, md5(k.text) AS kept_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op4_fair_queue_mixing": f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce({_WORDS.format('text')}, 0) AS BIGINT) AS size, row_number() OVER () AS row_no,
    md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '/', coalesce(md5(text), ''))) AS key FROM documents
), per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS budget FROM per
), filled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), marked AS (SELECT *, cap <= level * weight AS capped FROM filled),
targets AS (
  SELECT source, sid, budget, CAST(source_size AS BIGINT) AS source_size, CASE WHEN capped THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () * weight END AS target FROM marked
), queued AS (
  SELECT s.doc_id, s.row_no, s.size, t.sid, t.budget, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY t.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), packets AS (
  SELECT row_no, sid, budget, target, least(256, size - pack * 256) AS words,
    CAST(turn * source_size + before + least((pack + 1) * 256, size) AS DOUBLE) AS served
  FROM queued, (VALUES (0), (1)) turns(turn), LATERAL (SELECT unnest(range(CAST(ceil(size / 256) AS BIGINT))) AS pack)
), timed AS (
  SELECT row_no, words, budget, sum(words) OVER (ORDER BY served / target, sid, served) AS upto FROM packets
), mixed AS (
  SELECT row_no, sum(greatest(0, least(words, floor(budget) - (upto - words)))) AS taken FROM timed GROUP BY row_no
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM queued LEFT JOIN mixed USING (row_no)
""",
    "op12_snapshot_difference": f"""
WITH numbers AS (
  SELECT doc_id, text, lang, source, {_CRC} % 10 AS kind FROM documents
), later AS (
  SELECT unnest(CASE WHEN kind IN (3, 4) THEN [-1 - doc_id] WHEN kind = 5 THEN [doc_id, -1 - doc_id] ELSE [doc_id] END) AS key,
    CASE WHEN kind = 1 THEN concat(coalesce(text, ''), '+') ELSE text END AS text, CASE WHEN kind = 2 THEN source ELSE lang END AS lang,
    CASE WHEN kind = 2 THEN lang WHEN kind = 4 THEN NULL ELSE source END AS source
  FROM numbers WHERE kind IS DISTINCT FROM 0
), old AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_CONTENT}) AS n FROM documents
), new AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_CONTENT}) AS n FROM later
), met AS (
  SELECT a.n AS was, b.n AS now, a.doc_id AS old_key, b.key, a.text AS old_text, a.lang AS old_lang, a.source AS old_source, b.text, b.lang, b.source
  FROM old a FULL JOIN new b ON a.doc_id IS NOT DISTINCT FROM b.key AND a.n = b.n
), gone AS (
  SELECT *, row_number() OVER (PARTITION BY old_text, old_lang, old_source ORDER BY old_key) AS place FROM met WHERE now IS NULL
), come AS (
  SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY key) AS place FROM met WHERE was IS NULL
), moved AS (
  SELECT a.was, b.now, a.old_key, b.key, a.old_text, a.old_lang, a.old_source, b.text, b.lang, b.source
  FROM gone a FULL JOIN come b ON a.place = b.place AND a.old_text IS NOT DISTINCT FROM b.text AND a.old_lang IS NOT DISTINCT FROM b.lang
    AND a.old_source IS NOT DISTINCT FROM b.source
), pairs AS (
  SELECT *, TRUE AS same_key FROM met WHERE was IS NOT NULL AND now IS NOT NULL UNION ALL SELECT *, FALSE FROM moved
)
SELECT CASE WHEN now IS NULL THEN old_key ELSE key END AS key, old_key,
  CASE WHEN now IS NULL THEN 'delete' WHEN was IS NULL THEN 'insert' WHEN NOT same_key THEN 'rekey'
    WHEN old_text IS DISTINCT FROM text OR old_lang IS DISTINCT FROM lang OR old_source IS DISTINCT FROM source THEN 'update' ELSE 'same' END AS op,
  CASE WHEN now IS NULL OR was IS NULL THEN '' ELSE concat_ws(',', CASE WHEN old_text IS DISTINCT FROM text THEN 'text' END,
    CASE WHEN old_lang IS DISTINCT FROM lang THEN 'lang' END, CASE WHEN old_source IS DISTINCT FROM source THEN 'source' END) END AS changed,
  CASE WHEN now IS NOT NULL THEN sha256(concat(coalesce(text, '~'), chr(10), coalesce(lang, '~'), chr(10), coalesce(source, '~'))) END AS row_sha256
FROM pairs
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), lengths AS (SELECT row_no, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0
), totals AS (SELECT CAST(count(*) AS BIGINT) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM lengths
), asked AS (
  SELECT item_id, term, count(*) AS often FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), postings AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY row_no, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(N_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, totals GROUP BY term
), impacts AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_docs) // L))) AS impact
  FROM postings JOIN lengths USING (row_no) JOIN weights USING (term), totals
), scores AS (SELECT item_id, row_no, doc_id, CAST(sum(often * impact) AS BIGINT) AS score FROM impacts JOIN asked USING (term) GROUP BY item_id, row_no, doc_id
), best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM best WHERE rank <= 10
""",
}
