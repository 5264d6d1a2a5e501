"""The training-data operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, html_extract, lm, merkle, sharding, simhash, substring, suffixes, toxicity, warc
from .common import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_digest(table(spark, sf_dir, "documents"))


def tokenizer() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), *tokenizer())


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_html_extraction, op3_decontamination, op4_warc, op5_simhash, op6_lm_scoring, op7_sharding, op8_nearest_neighbours, op9_substring_dedup, op10_byte_bpe, op11_merkle_manifest, op12_suffix_dedup]
    return {f.__name__: f for f in own}


def _crc_table() -> list[int]:
    """CRC-32 of each byte, reflected polynomial."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


def _cuts(shards: int) -> str:
    """Greedy cuts, one after another."""
    return ", ".join(f"x{k} AS (SELECT COALESCE(MAX(e), 0) AS e FROM p WHERE e <= (SELECT e FROM x{k - 1}) + (SELECT c FROM best))" for k in range(1, shards))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT))),
          lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""


#: DuckDB SQL where it can express a query.
ORACLES = {
    "op7_sharding": f"""
WITH RECURSIVE t AS (SELECT {_crc_table()} AS crc),
d AS (SELECT doc_id, COALESCE(text, '') AS body, sha256(COALESCE(text, chr(0) || 'null')) AS digest FROM documents),
r AS (SELECT doc_id, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size, digest,
      {_CRC.format("body")} AS text_crc32
      FROM d, t),
g AS (SELECT digest, SUM(size) AS s FROM r GROUP BY digest),
p AS (SELECT digest, CAST(SUM(s) OVER (ORDER BY digest) AS BIGINT) AS e FROM g),
-- Least possible largest shard of the first groups, by number of shards.
m AS (SELECT 1 AS k, e, e AS c FROM p
      UNION ALL
      SELECT k + 1, z.e, MIN(GREATEST(c, z.e - m.e)) FROM m JOIN p z ON m.e <= z.e WHERE k < 16 GROUP BY k, z.e),
best AS (SELECT c FROM m WHERE k = 16 ORDER BY e DESC LIMIT 1),
x0 AS (SELECT CAST(0 AS BIGINT) AS e), {_cuts(16)},
cuts AS ({" UNION ALL ".join(f"SELECT e FROM x{k}" for k in range(1, 16))}),
placed AS (SELECT digest, CAST((SELECT COUNT(*) FROM cuts WHERE cuts.e < p.e) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       ROW_NUMBER() OVER (PARTITION BY shard ORDER BY digest, md5(COALESCE(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM r JOIN placed USING (digest)""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     h AS (SELECT *, MAX(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND head <> page_id THEN head END AS refers_to
FROM h""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     g AS (SELECT doc_id, i, list_aggregate(list_slice(ws, i, i + 34), 'string_agg', ' ') AS k
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
     c AS (SELECT k FROM g GROUP BY k HAVING COUNT(*) > 1),
     s AS (SELECT doc_id, list(i) AS starts FROM g JOIN c USING (k) GROUP BY doc_id),
     x AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, unnest(starts) AS i FROM s), (SELECT unnest(range(0, 35)) AS j)),
     gone AS (SELECT doc_id, list(pos) AS pos FROM x GROUP BY doc_id),
     kept AS (SELECT w.doc_id, w.ws, gone.pos FROM w LEFT JOIN gone USING (doc_id)),
     r AS (SELECT doc_id, COUNT(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t FROM
             (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM kept) u
           WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = u.doc_id AND x.pos = u.i) GROUP BY doc_id)
SELECT kept.doc_id, CAST(len(kept.ws) AS BIGINT) AS n_words, CAST(len(kept.ws) - COALESCE(r.n_kept, 0) AS BIGINT) AS n_removed,
       sha256(COALESCE(r.t, '')) AS kept_sha256
FROM kept LEFT JOIN r ON r.doc_id = kept.doc_id""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE c AS (SELECT {_crc_table()} AS crc),
d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS changed, COALESCE({_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 0, FALSE) AS tampered FROM documents, c),
l AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS x, DENSE_RANK() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, COUNT(*) OVER (PARTITION BY lang) AS n FROM d),
-- Nodes of the groups' trees, then of the tree over their roots.
t AS (SELECT tree, 0 AS level, i, leaf AS h, n FROM l
      UNION ALL
      SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
u AS (SELECT 0 AS level, tree AS i, h, (SELECT COUNT(DISTINCT tree) FROM l) AS n FROM t WHERE n = 1
      UNION ALL
      SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2, n),
-- Every row climbs its tree, then the upper one.
w AS (SELECT rid, tree, 0 AS level, i, x, '' AS siblings, n FROM l
      UNION ALL
      SELECT rid, w.tree, w.level + 1, w.i // 2, sha256(CASE WHEN s.h IS NULL THEN x WHEN s.i < w.i THEN s.h || x ELSE x || s.h END), siblings || COALESCE(s.h, ''), (w.n + 1) // 2
      FROM w LEFT JOIN t s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
v AS (SELECT rid, 0 AS level, tree AS i, x, siblings, (SELECT COUNT(DISTINCT tree) FROM l) AS n FROM w WHERE n = 1
      UNION ALL
      SELECT rid, v.level + 1, v.i // 2, sha256(CASE WHEN s.h IS NULL THEN x WHEN s.i < v.i THEN s.h || x ELSE x || s.h END), siblings || COALESCE(s.h, ''), (v.n + 1) // 2
      FROM v LEFT JOIN u s ON s.level = v.level AND s.i = xor(v.i, 1) WHERE v.n > 1),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, root, sha256(siblings) AS proof_sha256, v.x AS folded_root, v.x = root AS verified
FROM l JOIN v ON v.rid = l.rid AND v.n = 1 JOIN t ON t.tree = l.tree AND t.n = 1, r""",
    "op12_suffix_dedup": """
WITH b AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, hex(encode(COALESCE(text, ''))) AS x FROM documents),
-- Windows are cut from pieces of a thousand bytes, two hexadecimal digits a byte.
p AS (SELECT rid, doc_id, k, substr(x, 2000 * k + 1, 2098) AS s FROM (SELECT *, unnest(range(0, length(x) // 2000 + 1)) AS k FROM b)),
w AS (SELECT rid, doc_id, 1000 * k + j AS pos, substr(s, 2 * j + 1, 100) AS g
      FROM (SELECT *, unnest(range(0, LEAST(1000, GREATEST(length(s) // 2 - 49, 0)))) AS j FROM p)),
m AS (SELECT g, MIN(doc_id) AS earliest FROM w GROUP BY g),
h AS (SELECT rid, pos, LAG(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM w JOIN m USING (g) WHERE earliest < doc_id),
i AS (SELECT rid, pos, SUM(CASE WHEN before IS NULL OR pos - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS island FROM h),
r AS (SELECT rid, MIN(pos) AS a, MAX(pos) + 50 AS e FROM i GROUP BY rid, island),
c AS (SELECT rid, a, e, LAG(e, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS kept_from FROM r),
k AS (SELECT rid, COUNT(*) AS n_spans, SUM(e - a) AS n_removed, MAX(e) AS tail, string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept
      FROM c JOIN b USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN x ELSE kept || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM b LEFT JOIN k USING (rid)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
