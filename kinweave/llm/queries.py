"""The registered queries of this package: thin, over whole tables, digests of full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import (
    chat_format,
    decontamination,
    importance,
    licenses,
    mixing,
    near_duplicates,
    pii,
    quality_rules,
    site_quality,
    substring_dedup,
    token_output,
    toxicity,
    vector_codes,
)
from kinweave.plans.storage import materialize, scratch_path

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


@_query
def op8_token_output(spark, sf_dir):
    return token_digests(spark, _table(spark, sf_dir, "documents"))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents written as token-id chunks and read back as digests of their ids."""
    import public_tokenizers

    path = scratch_path(spark, "token_ids")
    token_output.write_token_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_output.read_token_ids(spark, path, digest=True)


@_query
def op3_quality_rules(spark, sf_dir):
    judged = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", *quality_rules.FIELDS[:5], "base_failed", "kept", "posterior"
    )


@_query
def op6_pii(spark, sf_dir):
    return pii.find_pii(_table(spark, sf_dir, "documents"), digest=True)


@_query
def op10_poisson_mix(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.root_weights(docs))


# Digit k of the hash, 13 hexadecimal digits, gives a 52-bit number; the Poisson sums are the
# running products of the operator, in the same order.
ORACLES["op10_poisson_mix"] = """
WITH RECURSIVE sizes AS (
    SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source
), rates AS (
    SELECT source,
           (SELECT sum(n) FROM sizes)::DOUBLE * w / (SELECT sum(w) FROM sizes) / n AS rate
    FROM sizes
), sums AS (
    SELECT source, rate, ceil(rate / 16)::INT AS parts, 0 AS k,
           exp(-rate / ceil(rate / 16)) AS p, exp(-rate / ceil(rate / 16)) AS below
    FROM rates
    UNION ALL
    SELECT source, rate, parts, k + 1, p * (rate / parts) / (k + 1),
           below + p * (rate / parts) / (k + 1)
    FROM sums WHERE k < 96
), draws AS (
    SELECT d.doc_id, part.i,
           ('0x' || substr(md5('20:' || d.doc_id || ':' || part.i), 1, 13))::BIGINT
               / 4503599627370496.0 AS u,
           d.source
    FROM documents d JOIN rates USING (source), range(1, 65) part(i)
    WHERE part.i <= ceil(rate / 16)
), counts AS (
    SELECT doc_id, sum((SELECT count(*) FROM sums s
                        WHERE s.source = draws.source AND s.k < 96 AND draws.u >= s.below)) AS n
    FROM draws GROUP BY doc_id
), copied AS (
    SELECT doc_id, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM counts
)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || substr(md5('20:order:' || doc_id || ':' || copy), 1, 13))::BIGINT
           / 4503599627370496.0 AS order_key
FROM copied JOIN documents USING (doc_id)
"""


@_query
def op9_decontamination(spark, sf_dir):
    judged = decontamination.decontaminate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    ids = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated"
    )


ORACLES["op9_decontamination"] = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), doc_words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n,
           array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
    FROM item_words, range(1, greatest(len(w) - 12, 1) + 1) t(i) WHERE len(w) > 0
), doc_windows AS (
    SELECT doc_id, i AS first, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM doc_words, (SELECT DISTINCT n FROM item_windows) sizes, range(1, len(w) - n + 2) t(i)
), hits AS (
    SELECT DISTINCT doc_id, first, d.n, item_id
    FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.n = i.n
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM hits, range(first, first + n) t(p) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
    FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


@_query
def op2_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op4_substring_dedup"] = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS win
    FROM doc_words, range(1, len(w) - 11) t(i)
), firsts AS (
    SELECT win, min(doc_id) AS first FROM windows GROUP BY win
), gone AS (
    SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (win), range(i, i + 13) t(p)
    WHERE first < doc_id
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc_words
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (doc_id)
"""


@_query
def op5_site_quality(spark, sf_dir):
    return site_quality.judge_sites(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


@_query
def op7_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op11_importance_resampling(spark, sf_dir):
    return importance.importance_ranks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


# DuckDB has no crc32, so its byte table comes from the rule and each different word is folded
# through it.
ORACLES["op11_importance_resampling"] = r"""
WITH RECURSIVE steps AS (
    SELECT i, i::BIGINT AS x, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1
    FROM steps WHERE k < 8
), crc AS (
    SELECT list(x ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
    SELECT true AS corpus, doc_id AS id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark
), split AS (
    SELECT corpus, id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), words AS (
    SELECT corpus, id, unnest(w) AS word FROM split
), bytes AS (
    SELECT word, list_transform(range(0, strlen(word)::BIGINT),
        lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b
    FROM (SELECT DISTINCT word FROM words)
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, crc
), counts AS (
    SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t
    FROM words JOIN hashed USING (word) GROUP BY bucket
), sums AS (
    SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (coalesce(all_s, 0) + 10000)
        / ((s + 1)::DOUBLE * (coalesce(all_t, 0) + 10000))))::BIGINT AS gain
    FROM counts, sums
), weights AS (
    SELECT id, sum(gain) AS weight
    FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE corpus GROUP BY id
), scored AS (
    SELECT id AS doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
    FROM split LEFT JOIN weights USING (id) WHERE corpus
), ordered AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS all_n
    FROM scored WHERE n >= 20
)
SELECT doc_id, n AS n_features, weight, score,
       CASE WHEN place <= 10 * all_n // 100 THEN place END AS rank
FROM scored LEFT JOIN ordered USING (doc_id)
"""


@_query
def op12_chat_format(spark, sf_dir):
    """The table's turns as a log of events, formatted into files and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    marks = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], turns.schema)
    log = materialize(chat_format.turns_as_log(turns.unionByName(marks)), "chat_log")
    path = scratch_path(spark, "formatted_chats")
    return chat_format.read_digests(spark, path, chat_format.write_formatted(log, path))


ORACLES["op12_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), rendered AS (
    SELECT *, length(regexp_replace(text,
        '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE |/ROLE\])', '\1\\\2\3', 'g'))
        + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 19
               ELSE 15 + length(url_encode(role)) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM rendered GROUP BY conv_id
"""


@_query
def op13_vector_codes(spark, sf_dir):
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))


def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds written out; squared distances are whole numbers below 2 ** 53."""

    def assigned(k: int) -> str:
        return f"""near{k} AS (
    SELECT id, p, min({{'far': list_inner_product(v, v) - 2 * list_inner_product(v, c)
        + list_inner_product(c, c), 'k': k}}) AS best
    FROM parts JOIN book{k} USING (p) GROUP BY id, p
)"""

    def updated(k: int) -> str:
        return f"""means{k} AS (
    SELECT p, k, list(mean ORDER BY d) AS c FROM (
        SELECT p, best.k AS k, d, floor(sum(v[d]) / count(*)) AS mean
        FROM parts JOIN near{k} USING (id, p), range(1, 17) t(d) GROUP BY p, best.k, d
    ) GROUP BY p, k
), book{k + 1} AS (
    SELECT p, k, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, k)
)"""

    steps = [s for k in range(rounds) for s in (assigned(k), updated(k))] + [assigned(rounds)]
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS id,
        list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT id, p, v[16 * p + 1 : 16 * p + 16] AS v FROM kept, range(4) t(p)
), book0 AS (
    SELECT p, id AS k, v AS c FROM parts WHERE id < 256
), {", ".join(steps)}, coded AS (
    SELECT id, string_agg(lower(lpad(to_hex(best.k), 2, '0')), '' ORDER BY p) AS code,
        sum(best.far)::BIGINT AS error
    FROM near{rounds} GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, k))
     FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""


ORACLES["op13_vector_codes"] = _vector_codes_sql()
