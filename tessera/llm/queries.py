"""The registered queries of this package: each dealt operator over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.session import prepare_session
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(lambda table: read_table(spark, sf_dir, table))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return keep


_COLLAPSE_SQL = """
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos
  FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns, list([role, text] ORDER BY pos) AS turns,
         string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
  FROM t GROUP BY conv_id),
one AS (
  SELECT turns, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered
  FROM c GROUP BY turns)
SELECT conv_id, CAST(0 AS BIGINT) AS part, n_turns, n_copies, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns)
"""


@query("op2_pairwise_gam")
def op2(table):
    from tessera.llm import quality_gam
    docs = table("documents")
    return quality_gam.score(docs, quality_gam.learn(docs, table("labels")))


@query("op3_chat_collapse", _COLLAPSE_SQL)
def op3(table):
    from tessera.llm import chat_collapse
    return chat_collapse.collapse_and_render(table("conversations"))


@query("op1_spaced_seeds")
def op1(table):
    from tessera.llm import decontam
    return decontam.overlaps(table("documents"), table("benchmark"))


@query("op4_golay_simhash")
def op4(table):
    from tessera.llm import simhash_golay
    return simhash_golay.near_duplicates(table("documents"), shingle=3, max_bits=3)


@query("op5_vector_packing")
def op5(table):
    from tessera.llm import packing, tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table("documents"), functools.partial(tokens.encoder_for, path))


@query("op6_nb_linear")
def op6(table):
    from tessera.llm import toxicity
    docs = table("documents")
    return toxicity.score(docs, toxicity.learn(docs, table("labels")))


#: Hand-written for 8 equal shards: with equal weights the least draw -ln(u) is the largest u.
_SHARDS_SQL = """
WITH crc AS (  -- the table of CRC-32, from its rule
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, list_transform(range(8), lambda i: i::UBIGINT)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
b AS (SELECT doc_id, octet_length(encode(x)) + 1 AS size, hex(encode(x)) AS h FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::UBIGINT,
        list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
        lambda c, v: xor(c >> 8, t[1 + CAST(xor(c, v) & 255 AS BIGINT)])), 4294967295) AS crc FROM b, crc),
u AS (SELECT *, list_transform(['0', '1', '2', '0/0', '0/1', '1/0', '1/1', '0/0/0', '0/0/1', '0/1/2', '0/1/3', '1/0/4', '1/0/5', '1/1/6', '1/1/7'],
        lambda p: (('0x' || substr(md5(p || '|' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS u FROM c),
g AS (SELECT *, CASE WHEN u[1] >= u[2] THEN 0 ELSE 1 END AS g FROM u),
r AS (SELECT *, CASE WHEN u[4 + 2 * g] >= u[5 + 2 * g] THEN 0 ELSE 1 END AS r FROM g),
s AS (SELECT *, 4 * g + 2 * r + CASE WHEN u[8 + 4 * g + 2 * r] >= u[9 + 4 * g + 2 * r] THEN 0 ELSE 1 END AS shard,
        ('0x' || substr(md5(doc_id || '|' || crc), 1, 12))::BIGINT % 1024 AS bucket FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, crc, size) - 1 AS slot,
  CAST(CASE WHEN -ln(u[3]) < -ln(greatest(u[1], u[2])) / 4 THEN 8 ELSE shard END AS INTEGER) AS grown_shard
FROM s
"""


@query("op7_hash_tree_shards", _SHARDS_SQL)
def op7(table):
    from tessera.llm import sharding
    return sharding.shard_rows(table("documents"), sharding.even_topology(8))


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5
"""


@query("op8_kd_search", _TOP_SQL)
def op8(table):
    from tessera.llm import kd_search
    return kd_search.top_k(table("embeddings"), k=5, every=50)


#: The key of the registered queries; a deployment passes its own secret.
PII_KEY = "registered-query"


@query("op10_pii_surrogates")
def op10(table):
    from tessera.llm import pii
    return pii.replace(table("documents"), PII_KEY)


@query("op9_wrapper_text")
def op9(table):
    from tessera.llm import html_wrapper
    return html_wrapper.main_texts(table("pages"))


_MANIFEST_SQL = """
WITH RECURSIVE crc AS (  -- the table of CRC-32, from its rule
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, list_transform(range(8), lambda i: i::UBIGINT)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
f AS (
  SELECT row_number() OVER () AS id, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
    coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(CAST(doc_id AS VARCHAR))),
          lambda i: ('0x' || substr(hex(encode(CAST(doc_id AS VARCHAR))), 2 * i + 1, 2))::UBIGINT)),
        lambda c, v: xor(c >> 8, t[1 + CAST(xor(c, v) & 255 AS BIGINT)])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc),
l AS (
  SELECT id, doc_id, lang, sha256(head || chars || tail) AS leaf,
    sha256(head || CASE WHEN tampered THEN more ELSE chars END || tail) AS claimed FROM f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes AS (
  SELECT lang, CAST(0 AS BIGINT) AS lev, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n, leaf AS h FROM ranked
  UNION ALL
  SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY lang, lev, pos // 2, n),
subs AS (
  SELECT lang, lev AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS sat, count(*) OVER () AS sn FROM nodes WHERE n = 1),
tops AS (
  SELECT CAST(0 AS BIGINT) AS lev, CAST(sat AS BIGINT) AS pos, CAST(sn AS BIGINT) AS n, subroot AS h FROM subs
  UNION ALL
  SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lev, pos // 2, n),
whole AS (SELECT lev AS top_height, h AS root FROM tops WHERE n = 1),
r AS (SELECT ranked.*, height, subroot, sat, top_height, root FROM ranked JOIN subs ON ranked.lang IS NOT DISTINCT FROM subs.lang, whole),
steps AS (  -- the sibling of each level, through the subroot up to the root
  SELECT r.id, g.lev, r.pos >> g.lev AS pos, s.h AS sib FROM r, LATERAL (SELECT unnest(range(height)) AS lev) g
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.lev = g.lev AND s.pos = xor(r.pos >> g.lev, 1)
  UNION ALL
  SELECT r.id, r.height + g.lev, r.sat >> g.lev, s.h FROM r, LATERAL (SELECT unnest(range(top_height)) AS lev) g
  LEFT JOIN tops s ON s.lev = g.lev AND s.pos = xor(r.sat >> g.lev, 1)),
proofs AS (SELECT id, sha256(string_agg(coalesce(sib, ''), '' ORDER BY lev)) AS p FROM steps GROUP BY id),
folds AS (
  SELECT id, CAST(0 AS BIGINT) AS lev, claimed AS h FROM r
  UNION ALL
  SELECT folds.id, folds.lev + 1, sha256(CASE WHEN sib IS NULL THEN h WHEN pos & 1 = 1 THEN sib || h ELSE h || sib END)
  FROM folds JOIN steps ON steps.id = folds.id AND steps.lev = folds.lev),
ends AS (SELECT id, arg_max(h, lev) AS folded FROM folds GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified,
  2 * pos - bit_count(pos) AS position
FROM r JOIN ends ON ends.id = r.id LEFT JOIN proofs ON proofs.id = r.id
"""


@query("op12_merkle_log", _MANIFEST_SQL)
def op12(table):
    from tessera.llm import merkle_log
    return merkle_log.audited(table("documents"))


@query("op11_signature_rules")
def op11(table):
    from tessera.llm import license_scan
    return license_scan.scan_documents(table("documents")).drop("detections")


@query("op13_distinct_texts")
def op13(table):
    from tessera.llm import cross_tokens
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return cross_tokens.align_documents(table("documents"), functools.partial(cross_tokens.aligner_for, *files)).documents
