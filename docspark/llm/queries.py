"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, histogram_packing, jaccard_join, language_model, packing, passages, periodic_runs, pii, spelling_groups, suffix_dedup, token_store, toxicity
from .common import shared_folder
from .shared_keys import parts_for

#: The tokenizer file of the token queries; by default the public vocabulary that is installed beside Python.
TOKENIZER_VARIABLE = "DOCSPARK_TOKENIZER"
STORE_END, PACK_END, HISTOGRAM_END = 2, 0, 1
#: One of so many words of a document is misspelt in ``op11_spelling_groups``.
MISSPELL = 97


def tokenizer_path() -> str:
    if given := os.environ.get(TOKENIZER_VARIABLE):
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).drop("n_bytes", "mark")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(docs, path, tokenizer_path(), STORE_END, parts_for(docs, 8_000_000, 1))
    return token_store.stored_digests(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_read(spark, sf_dir, "documents"), tokenizer_path(), PACK_END))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.fit_and_score(_read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_links(_read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(_read(spark, sf_dir, "documents")).drop("mark")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(_read(spark, sf_dir, "documents"), MISSPELL)


def op12_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), HISTOGRAM_END)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_read(spark, sf_dir, "documents"), periodic_runs.planted).drop("runs", "collapsed")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_exact_dedup, op3_toxicity, op4_token_store, op5_packing, op6_lm_scoring, op7_suffix_dedup, op8_pii, op9_substring_dedup, op10_jaccard_join, op11_spelling_groups, op12_histogram_packing, op13_periodic_runs)}

_WORDS_SQL = "list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
_KINDS_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(part, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0"),
    (
        "card",
        r"[0-9](?:[ -]?[0-9])+",
        "length(regexp_replace(part, '[^0-9]', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(part, '[^0-9]', '', 'g')) + 1), "
        "lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(part, '[^0-9]', '', 'g')), i, 1)::INT ELSE 2 * substr(reverse(regexp_replace(part, '[^0-9]', '', 'g')), i, 1)::INT - CASE WHEN substr(reverse(regexp_replace(part, '[^0-9]', '', 'g')), i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
    ),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(part, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
)


def _pii_sql() -> str:
    parts = []
    for rank, (kind, pattern, valid) in enumerate(_KINDS_SQL):
        split = f"string_split(regexp_replace(translate(coalesce(text, ''), chr(1), chr(2)), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
        parts.append(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(part) AS stop FROM (SELECT doc_id, parts[i] AS part, i, coalesce(list_sum(list_transform(parts[1:i - 1], lambda p: length(p))), 0)::BIGINT AS start FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {split} AS parts FROM documents))) WHERE i % 2 = 0 AND {valid}")
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in _KINDS_SQL)
    return f"WITH s AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {counts}, sha256({listed}) AS base_sha256, {listed} AS spans FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"

#: crc32 of the bytes of ``key`` (at most U+00FF each), bit by bit; a table of the 256 remainders keeps it quick.
_CRC_SQL = """list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b::BIGINT))"""
_BYTES_SQL = "flatten(list_transform(string_split(key, ''), lambda ch: CASE WHEN ascii(ch) < 128 THEN [ascii(ch)::BIGINT] ELSE [(192 + (unicode(ch) >> 6))::BIGINT, (128 + (unicode(ch) & 63))::BIGINT] END))"


ORACLES = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i:i + least(len(w), 10) - 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, i, size, w[i:i + size - 1] AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, size FROM spots JOIN win USING (size, phrase)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op8_pii": _pii_sql(),
    "op11_spelling_groups": f"""
WITH RECURSIVE t AS (SELECT {_CRC_SQL} AS r),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs GROUP BY 1, 2),
summed AS (SELECT run, k, xor(list_reduce({_BYTES_SQL}, lambda v, b: xor(v >> 8, r[(xor(v, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM each, t),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS top FROM near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN other END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root FROM f UNION ALL SELECT path.word, f.form FROM path JOIN f ON f.word = path.root WHERE f.form IS NOT NULL),
ends AS (SELECT path.word, root FROM path JOIN f ON f.word = path.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)""",
}
