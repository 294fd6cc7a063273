"""The operators with production parameters over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emipanel.llm import alignment, fagin, jaccard, langid, mixing, packing, pii, quality, substring, trie, urls, vptree, wavelet
from emipanel.llm.common import crc_mod, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"))


@query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs.filter(crc_mod("doc_id", 4) != 2)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op10_fagin(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return fagin.top_scores(vectors, vectors.filter("vec_id % 50 = 0"))


@query
def op11_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


_USABLE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

ORACLES["op10_fagin"] = f"""WITH {_USABLE},
w AS (SELECT vec_id, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

ORACLES["op9_vptree"] = f"""WITH {_USABLE},
w AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM w q JOIN w c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

#: crc32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda a: CAST(ascii(a) AS UBIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
      lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

ORACLES["op12_prefix_trie"] = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, CAST({_CRC} % 4 AS BIGINT) AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.p AS pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.p - c.h, t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.p > c.h),
s AS (SELECT conv_id, pos, text, sha256(CAST(to_json(list([role, text]) OVER (PARTITION BY conv_id ORDER BY pos)) AS VARCHAR)) AS k FROM r
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
n AS (SELECT pos AS depth, k, min(conv_id) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS saved FROM s GROUP BY pos, k),
p AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN s a ON a.conv_id = n.conv_id AND a.pos = n.depth - 1
  LEFT JOIN n u ON u.depth = a.pos AND u.k = a.k),
f AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM p WHERE depth > 0 GROUP BY ALL),
g AS (SELECT p.*, coalesce(f.n, 0) AS n_children FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.depth = p.depth),
sums AS (SELECT a.pos AS depth, a.k, count(*) FILTER (g.n_children = 0) AS n_leaves, sum(g.saved) AS saved
  FROM g JOIN s a ON a.conv_id = g.conv_id AND a.pos <= g.depth GROUP BY a.pos, a.k),
e AS (SELECT pos AS depth, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, pos, k FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1) GROUP BY pos, k)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, g.parent_conv_id, g.n_convs, CAST(g.n_children AS BIGINT) AS n_children,
  CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM g JOIN sums ON sums.depth = g.depth AND sums.k = g.k LEFT JOIN e ON e.depth = g.depth AND e.k = g.k"""
