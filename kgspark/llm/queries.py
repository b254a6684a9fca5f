"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.checkpoints import saved, scratch, scratch_path

from . import bpe, chat, langid, licenses, media, neardup, packing, quality, store, substrings
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality.score(documents(spark, sf_dir)).select(*names)


def with_ranges(found: DataFrame) -> DataFrame:
    ranges = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["first"], x["behind"])), ",").alias(c)
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", ranges("chosen_mask"), "rejected", ranges("rejected_mask"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ranges(chat.preferences(*chat.swapped_answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op4_chat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every conversation; op4_chat pairs only conv_id XOR 1, as its SQL does."""
    return with_ranges(chat.preferences(*chat.branched(spark.read.parquet(f"{sf_dir}/conversations.parquet")), one_sided=True))


def op5_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the store goes when its rows are written
        path = scratch_path(spark, "store")
        store.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
        return saved(store.read(spark, path), "store-rows", keep=True)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "doc_id n_words n_base first_word last_word base_labels labels score freedom postfix".split()
    return licenses.scan(documents(spark, sf_dir)).select(*names)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op8_licenses, which SQL can express."""
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_media that SQL can express."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


LICENSES_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
ph(words, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
hits AS (SELECT k, p, words, label FROM (SELECT k, ws, unnest(generate_series(1, len(ws))) AS p FROM w), ph WHERE ws[p] = words[1] AND ws[p:p + len(words) - 1] = words),
n AS (SELECT k, count(*) AS n, min(p) - 1 AS a, max(p) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN n USING (k)
"""

MEDIA_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
s AS (SELECT doc_id, body, octet_length(body) AS n, greatest(64, CAST(ceil(octet_length(body) / 64) AS BIGINT) * 64) AS m FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(body || repeat('\x00'::BLOB, m - n)) AS payload_sha256 FROM s
"""

OP4_SQL = r"""
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
l AS (SELECT pair_id, max(turn) AS lt, arg_max(text, turn) AS own FROM t WHERE role = 'assistant' GROUP BY pair_id),
p AS (SELECT l.pair_id, l.lt, l.own, o.own AS other FROM l JOIN l o ON o.pair_id = xor(l.pair_id, 1)),
s AS (SELECT pair_id, count(*) AS n, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn), '') AS prompt FROM t JOIN p USING (pair_id) WHERE turn < lt GROUP BY pair_id)
SELECT pair_id, CAST(coalesce(n, 0) AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  '<|assistant|>' || chr(10) || own || '<|end|>' || chr(10) AS chosen, '14-' || (14 + length(own)) AS chosen_mask,
  '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) AS rejected, '14-' || (14 + length(other)) AS rejected_mask
FROM p LEFT JOIN s USING (pair_id)
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
win AS (SELECT k, p, array_to_string(ws[p:p + 4], ' ') AS s FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 4)) AS p FROM w)),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, p + j AS q FROM (SELECT k, p, count(*) OVER (PARTITION BY k, s) AS c FROM win), unnest(generate_series(0, 4)) AS u(j) WHERE c > 1) GROUP BY k),
ln AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM w),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality.STOP_WORDS)}))) AS n_stop
  FROM w JOIN ln USING (k) LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_repeat_words / n_words > 0.2 OR word_chars / n_words NOT BETWEEN 1.5 AND 25 OR n_symbols / n_words > 0.35 OR (n_words >= 50 AND n_stop / n_words < 0.04) OR (n_lines > 0 AND n_dup_lines / n_lines > 0.5)) AS kept
FROM b
"""

OP6_SQL = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, k, p, array_to_string(ws[p:p + 12], ' ') AS s FROM (SELECT doc_id, k, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w)),
gone AS (SELECT DISTINCT k, p + j AS q FROM (SELECT doc_id, k, p, min(doc_id) OVER (PARTITION BY s) AS least FROM win), unnest(generate_series(0, 12)) AS u(j) WHERE doc_id > least),
each AS (SELECT k, q, ws[q] AS x FROM (SELECT k, ws, unnest(generate_series(1, len(ws))) AS q FROM w)),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY q) AS body FROM each ANTI JOIN gone USING (k, q) GROUP BY k),
n AS (SELECT k, count(*) AS n_removed FROM gone GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (k) LEFT JOIN n USING (k)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id, w.doc_id = coalesce(c.least, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def queries() -> dict[str, Query]:
    more = {"licenses_base": licenses_base, "media_base": media_base}
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | more


def oracle_sql() -> dict[str, str]:
    return {"op3_quality": OP3_SQL, "op4_chat": OP4_SQL, "op6_substrings": OP6_SQL, "op9_neardup": OP9_SQL, "licenses_base": LICENSES_SQL, "media_base": MEDIA_SQL}
