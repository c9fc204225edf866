"""The thirteen operators as queries over whole tables, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import (bbit_minhash, bfd_packing, chaining, containment, divergence_rules, host_suffix,
                            nra_search, pairwise_quality, simplex_clusters, subword_langid, token_rollup, topk_inner,
                            warc_index)
from ledgerflow.llm.common import importable, stored
from ledgerflow.session import scratch_path

VERSIONS = {"word_bpe_49k": ("word_bpe_49k", None), "byte_bpe_50k": ("byte_bpe_50k", None)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back through the merged index."""
    return warc_index.capture_index(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three words, 85 per cent."""
    return bbit_minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, threshold=0.85).drop("text_hash")


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold: five words, 80 per cent of an item."""
    return containment.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_topk_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best integer inner products of every fiftieth vector with all others."""
    return topk_inner.top_k_inner(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document has as well."""
    return chaining.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    x = pairwise_quality.featured(docs)
    return pairwise_quality.quality_scores(docs, pairwise_quality.train(docs, _table(spark, sf_dir, "labels"), x=x), x=x)


def op7_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return host_suffix.main_text(_table(spark, sf_dir, "pages"))


def op8_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return subword_langid.language_of(docs, subword_langid.train(docs)).drop("rejected")


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches: all documents inserted, later copies of a
    text deleted, documents with a license line revised to their text without it;
    the second batch comes twice."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"), VERSIONS)
    rollup.apply(1, docs.withColumn("op", F.lit("insert")))
    copies = later_copies(docs)
    rollup.apply(2, copies)
    line = r"(?m)^Licensed under [^\n]*\n?"
    licensed = docs.where(F.col("text").contains("Licensed under ") & F.col("text").rlike(line))
    gone = copies.select("doc_id")
    rollup.apply(3, licensed.join(gone, "doc_id", "left_anti")
                 .withColumn("text", F.regexp_replace("text", line, "")).withColumn("op", F.lit("revise")))
    rollup.apply(2, copies)
    return rollup.totals()


def later_copies(docs: DataFrame) -> DataFrame:
    """Delete rows for documents whose text an earlier document (by doc_id) has."""
    named = docs.where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = stored(named.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1").drop("n"), "first-copies")
    none = F.lit(None).cast("string")
    return stored(named.join(first, "sha").where("doc_id > first")
                  .select(F.lit("delete").alias("op"), "doc_id", none.alias("source"), none.alias("lang"),
                          none.alias("text")), "later-copies")


def op10_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return bfd_packing.piece_digests(bfd_packing.packed_sequences(_table(spark, sf_dir, "documents")))


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight integer centroids over all embeddings, ten rounds."""
    return simplex_clusters.clusters(_table(spark, sf_dir, "embeddings"))


def op12_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return nra_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of all documents."""
    return divergence_rules.judged(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


QUERIES = {f.__name__: f for f in (
    op1_warc_index, op2_bbit_minhash, op3_containment, op4_topk_inner, op5_chaining, op6_pairwise_quality,
    op7_host_suffix, op8_subword_langid, op9_token_rollup, op10_bfd_packing, op11_simplex_clusters, op12_nra_search,
    op13_divergence_rules)}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _cluster_rounds(rounds: int) -> str:
    """Ten rounds of assignment and floor means, each as three tables."""
    each = []
    for i in range(rounds + 1):
        each.append(f"""
d{i} AS MATERIALIZED (
  SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{i} c USING (j) GROUP BY ALL
), a{i} AS MATERIALIZED (
  SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if i < rounds:
            each.append(f"""
s{i} AS (
  SELECT a.c, x.j, sum(x.x) AS s, count(*) AS n FROM x JOIN a{i} a USING (r) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT c.c, c.j, CASE WHEN n IS NULL THEN c.x ELSE (s - (s % n + n) % n) // n END AS x
  FROM c{i} c LEFT JOIN s{i} USING (c, j)
)""")
    return ",".join(each)


ORACLES = {
    "op1_warc_index": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_LETTERS}', 1 + CAST(
      (CAST(('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31
      AS INTEGER), 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex, payload_bytes) AS owner
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d""",
    "op2_bbit_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS ss FROM w
), e AS (
  SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS x
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), l AS (
  SELECT u, v FROM c WHERE 100 * x >= 85 * (nu + nv - x)
), r AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.v FROM r JOIN l ON r.seen = l.u
), m AS (
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1
)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m USING (doc_id)""",
    "op3_containment": r"""
WITH w AS (
  SELECT false AS doc, item_id AS id, text FROM benchmark UNION ALL SELECT true, doc_id, text FROM documents
), ws AS (
  SELECT doc, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM w
), i AS (
  SELECT id, len(ws) AS k, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda j: array_to_string(ws[j:j + 4], ' '))) END) AS g
  FROM ws WHERE NOT doc
), n AS (
  SELECT id, count(*) AS n FROM i GROUP BY 1
), d AS (
  SELECT DISTINCT id, array_to_string(ws[j:j + k - 1], ' ') AS g
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j
        FROM ws, (SELECT DISTINCT least(k, 5) AS k FROM i) WHERE doc AND len(ws) >= k)
), x AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM d JOIN i USING (g) GROUP BY 1, 2
)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM x JOIN n ON x.item_id = n.id WHERE 10 * n_shared >= 8 * n""",
    "op4_topk_inner": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score FROM s QUALIFY rank <= 5""",
    "op11_simplex_clusters": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS j, unnest(e) AS x FROM v
), c0 AS MATERIALIZED (
  SELECT c, unnest(range(64)) AS j, unnest(e) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < 8)
),{_cluster_rounds(10)}, h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c10 GROUP BY c
)
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  centroid_sha256
FROM a10 a JOIN v USING (r) JOIN h USING (c)""",
    "op12_nra_search": rf"""
WITH t AS (
  SELECT doc, row_number() OVER () AS r, id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT true AS doc, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark)
), d AS MATERIALIZED (
  SELECT r, id, ws, CAST(len(ws) AS BIGINT) AS n FROM t WHERE doc AND len(ws) > 0
), z AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d
), f AS MATERIALIZED (
  SELECT r, id, n, term, count(*) AS tf FROM (SELECT r, id, n, unnest(ws) AS term FROM d) GROUP BY ALL
), q AS (
  SELECT DISTINCT id AS item_id, unnest(ws) AS term FROM t WHERE NOT doc
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(docs) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w
  FROM f, z GROUP BY term
), s AS (
  SELECT q.item_id, f.r, f.id AS doc_id,
    CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), z GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_divergence_rules": rf"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, '=' || lang AS own, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words
  FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), range(3) AS t(o) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), e AS (
  SELECT own, unnest(ws) AS word FROM w WHERE len(text) >= {divergence_rules.MIN_CHARS}
), cnt AS (
  SELECT key, word, count(*) AS n FROM (
    SELECT '{divergence_rules.ALL}' AS key, word FROM e UNION ALL SELECT own, word FROM e WHERE own IS NOT NULL) GROUP BY ALL
), held AS MATERIALIZED (
  SELECT key, sum(n) AS total FROM cnt GROUP BY key
  HAVING total * {divergence_rules.MIN_SHARE} >= (SELECT count(*) FROM e)
), common AS MATERIALIZED (
  SELECT key, word, n / total AS q FROM cnt JOIN held USING (key) WHERE n * {divergence_rules.COMMON} >= total
), k AS MATERIALIZED (
  SELECT w.*, CASE WHEN own IN (SELECT key FROM held) THEN own ELSE '{divergence_rules.ALL}' END AS key,
    len(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS c1, len(regexp_replace(text, '\P{{L}}', '', 'g')) - c1 AS c2,
    len(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS c3, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS c4,
    len(text) - c1 - c2 - c3 - c4 AS c5 FROM w
), hist AS (
  SELECT r, key, i, [c1, c2, c3, c4, c5][i] AS n FROM k, range(1, 6) AS t(i)
), refs AS (
  SELECT key, i, sum(n) AS n FROM (
    SELECT h.key, i, n FROM hist h JOIN k USING (r) WHERE len(text) >= {divergence_rules.MIN_CHARS} AND h.key <> '{divergence_rules.ALL}'
    UNION ALL
    SELECT '{divergence_rules.ALL}', i, n FROM hist h JOIN k USING (r) WHERE len(text) >= {divergence_rules.MIN_CHARS}) GROUP BY ALL
), cpq AS (
  SELECT r, h.n / sum(h.n) OVER (PARTITION BY r) AS p, f.n / sum(f.n) OVER (PARTITION BY r) AS q
  FROM hist h JOIN refs f USING (key, i)
), cdist AS (
  SELECT r, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 0) / 2) AS dist FROM cpq GROUP BY r
), hit AS (
  SELECT r, key, word, count(*) AS n FROM (SELECT r, key, unnest(ws) AS word FROM k WHERE len(ws) >= {divergence_rules.GUARD})
  SEMI JOIN common USING (key, word) GROUP BY ALL
), bin AS (
  SELECT k.r, coalesce(h.n, 0) / len(k.ws) AS p, c.q
  FROM k JOIN common c USING (key) LEFT JOIN hit h ON h.r = k.r AND h.word = c.word WHERE len(k.ws) >= {divergence_rules.GUARD}
), wpq AS (
  SELECT r, p, q FROM bin UNION ALL
  SELECT k.r, 1 - coalesce(sum(p), 0), 1 - coalesce(sum(q), 0) FROM k LEFT JOIN bin USING (r)
  WHERE len(k.ws) >= {divergence_rules.GUARD} GROUP BY k.r
), wdist AS (
  SELECT r, sqrt(greatest(sum(CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 1e-12 THEN q * log2(2 * q / (p + q)) ELSE 0 END), 0) / 2) AS dist FROM wpq GROUP BY r
), bins AS (
  SELECT key, count(*) AS n FROM common GROUP BY key
), m AS (
  SELECT k.*, len(ws) AS n_words, len(text) - c3 AS word_chars, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, cdist.dist AS cd, wdist.dist AS wd, coalesce(bins.n, 0) AS n_bins
  FROM k LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r) LEFT JOIN bins USING (key)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c4 AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT base_failed AND (n_words < {divergence_rules.GUARD} OR (
    coalesce(cd <= {divergence_rules.CHAR_LIMIT} + sqrt(5 / (8.0 * word_chars)), true)
    AND coalesce(wd <= {divergence_rules.WORD_LIMIT} + sqrt(n_bins / (8.0 * n_words)), true))) AS kept
FROM m""",
}
