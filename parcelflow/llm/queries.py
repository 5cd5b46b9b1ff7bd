"""Registered queries of the operators, one per operator, over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, conversation_trie, exact, hmm, licenses, mixing, pii, quality, sharding, simhash, suffix_dedup, toxicity

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_suffix_family")
def op1_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


@query("op2_extendible_dedup", """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""")
def op2_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(documents(spark, sf_dir)).drop("key", "bucket")


@query("op3_boosted_pii")
def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.detect(documents(spark, sf_dir)))


@query("op4_fair_mixing")
def op4_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op5_ordinal_toxicity")
def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op6_trie_bpe")
def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


@query("op7_quality_ledger")
def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.apply_policy(quality.ledger(documents(spark, sf_dir)))
    bits = entries["failed"].bitwiseAND(quality.mask(quality.BASE))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (bits != 0).alias("base_failed"), "kept", "failed"
    )


@query("op8_license_rules")
def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


@query("op9_covering_simhash")
def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir))


@query("op10_sampled_splitters")
def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query("op11_hidden_markov")
def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir))


@query("op13_setm_collocations", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) AS sizes WHERE len(w) >= k
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS lhs, array_to_string(w[cut + 1:k], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), judged AS (
  SELECT c.*, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM cuts AS c JOIN counts AS l ON l.lang = c.lang AND l.phrase = c.lhs JOIN counts AS r ON r.lang = c.lang AND r.phrase = c.rhs
), lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[start:start + size - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS start FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates WHERE k > 2)) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest AS x LEFT JOIN inside AS i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * a
) AS y JOIN totals USING (lang) WHERE rank <= 2000
""")
def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


@query("op12_prefix_trie", """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), named AS (SELECT conv_id, pos, dense_rank() OVER (ORDER BY role, text) AS id, length(text) AS size FROM turns),
heads AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM named)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.id FROM heads AS c JOIN named AS o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.id FROM heads AS c JOIN named AS o ON o.conv_id = c.conv_id AND o.pos > c.h
), lists AS (
  SELECT h.conv_id, coalesce(list(r.id ORDER BY r.part, r.pos) FILTER (r.id IS NOT NULL), []) AS s FROM heads AS h LEFT JOIN rebuilt AS r USING (conv_id) GROUP BY h.conv_id
), sizes AS (SELECT id, any_value(size) AS size FROM named GROUP BY id),
members AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM lists),
nodes AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends
  FROM members GROUP BY 1, 2
), parents AS (
  SELECT x.*, q.conv_id AS above, coalesce(k.children, 0) AS children, (x.n - 1) * coalesce(z.size, 0) AS own
  FROM nodes AS x LEFT JOIN nodes AS q ON x.depth > 0 AND q.depth = x.depth - 1 AND q.p = x.p[1:x.depth - 1]
  LEFT JOIN (SELECT p[1:depth - 1] AS p, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY 1) AS k ON k.p = x.p
  LEFT JOIN sizes AS z ON x.depth > 0 AND z.id = x.p[x.depth]
), sums AS (
  SELECT p[1:upto] AS p, count(*) FILTER (children = 0) AS leaves, sum(own) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS upto FROM parents) GROUP BY 1
)
SELECT x.conv_id, x.depth, x.above AS parent_conv_id, x.n AS n_convs, x.children AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM parents AS x JOIN sums AS s ON s.p = x.p
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
