"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import decontaminate, extract, langid, ogg, packing, phrases, pii, prefixes, simhash, suffix, tokencount, toxicity, warc
from quadrat.llm.common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages
), r AS (
  SELECT *, strlen(body) >= 1000 AND page_id IS DISTINCT FROM keeper AS again FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to
FROM r
"""

def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(text, '') AS text,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, tok, strlen(text) AS b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tok) AS i FROM t
), codes AS (
  SELECT DISTINCT c, c - c % 5 AS base, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)) AS code FROM t
), h AS (
  SELECT c, base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), code), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM codes
), m AS (
  SELECT h.c, h.base, h.h, count(own.i) AS m FROM h LEFT JOIN own ON own.c = h.base AND own.i <= h.h GROUP BY ALL
), seq AS (
  SELECT m.c, own.i, tok, b FROM m JOIN own ON own.c = m.base AND own.i <= m.h
  UNION ALL
  SELECT m.c, own.i - m.h + m.m, tok, b FROM m JOIN own ON own.c = m.c AND own.i > m.h
), named AS (
  SELECT c, i, b, md5(string_agg(tok, '') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING)) AS name FROM seq
), p AS (
  SELECT *, coalesce(lag(name) OVER (PARTITION BY c ORDER BY i), '') AS parent FROM named
  UNION ALL SELECT c, 0, 0, '', NULL FROM m
), nodes AS (
  SELECT name, i AS depth, any_value(parent) AS parent, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(b) AS saved FROM p GROUP BY name, i
), kids AS (
  SELECT parent AS name, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT p.name, sum(CASE WHEN kids.name IS NULL THEN 1 ELSE 0 END) AS leaves, sum(d.saved) AS saved
  FROM nodes AS d JOIN p ON p.c = d.c AND p.i <= d.depth LEFT JOIN kids ON kids.name = d.name GROUP BY 1
), lasts AS (
  SELECT c, arg_max(name, i) AS name FROM p GROUP BY c
), ends AS (
  SELECT name, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS digest FROM lasts GROUP BY name
)
SELECT x.c AS conv_id, CAST(x.depth AS BIGINT) AS depth, up.c AS parent_conv_id, CAST(x.n AS BIGINT) AS n_convs,
       CAST(coalesce(kids.kids, 0) AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
       CAST(below.saved AS BIGINT) AS saved_tokens, coalesce(ends.digest, sha256('')) AS ends_sha256
FROM nodes AS x LEFT JOIN nodes AS up ON up.name = x.parent LEFT JOIN kids ON kids.name = x.name
LEFT JOIN below ON below.name = x.name LEFT JOIN ends ON ends.name = x.name
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\x20\x09]+'), lambda w: w <> '') AS w FROM t
), g AS (
  SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase
  FROM p, range(1, 6) AS r(len) WHERE len(w) >= len
), f AS (
  SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang
), c AS (
  SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND f >= 100
), inside AS (
  SELECT c.lang, array_to_string(c.w[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM c, range(2, 5) AS sizes(s), range(1, 5) AS starts(i) WHERE s < len AND i + s - 1 <= len GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n.n,
         CAST((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM c JOIN n USING (lang), range(1, 5) AS ks(k), f AS x, f AS y
  WHERE k < c.len AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
    AND y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.len], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best AS b LEFT JOIN inside AS i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE i.most IS NULL OR i.most < a
QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_extract": op2_extract,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_ogg": op7_ogg,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_suffix": op10_suffix,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op13_phrases": OP13_SQL}
