"""Registered queries of the training-data operators, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontaminate, divergence, flatgraph, leaks, minmax, mixing, passages, pii, spans, substrings, tokens, toxicity, whitening
from .store import new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op8_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85 and more, over all documents."""
    return minmax.near_duplicates(_table(spark, sf_dir, "documents")).drop("chosen")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""


@_query
def op4_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of every benchmark item in all documents."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op4_fm_index_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 13) AS k, array_to_string(list_slice(ws, p, p + 12), ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, p, array_to_string(list_slice(ws, p, p + k - 1), ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT doc_id, dw.k, p, item_id FROM dw JOIN win USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit
          FROM (SELECT doc_id, unnest(range(p, p + k)) AS w FROM (SELECT DISTINCT doc_id, k, p FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _digested(found: DataFrame, kinds: tuple[str, ...], *more: Column) -> DataFrame:
    return found.select("doc_id", *(spans.count_kind("spans", k).alias(f"n_{k}") for k in kinds),
                        spans.base_digest("spans").alias("base_sha256"), spans.listed(F.col("spans")).alias("spans"), *more)


@_query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, card, phone and account numbers in all documents."""
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    scored = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["score"].cast("string")))
    return _digested(found, pii.KINDS[:4], F.array_join(scored, ",").alias("scores"))


@_query
def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, through a ledger that starts empty."""
    return _digested(leaks.secrets(_table(spark, sf_dir, "documents"), new_path(spark, "ledger")), leaks.KINDS[:3])


@_query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighted 5, 2, 1 in turn."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1]::DOUBLE AS w FROM s),
o AS (SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY 3 * s / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wrest FROM w),
f AS (SELECT *, rest::DOUBLE / wrest AS level FROM o),
lv AS (SELECT min_by(level, 3 * s / w) AS level, min(3 * s / w) AS edge FROM f WHERE level <= 3 * s / w),
t AS (SELECT source, s, CASE WHEN lv.edge IS NULL OR 3 * s / w < lv.edge THEN (3 * s)::DOUBLE ELSE lv.level * w END AS target FROM w, lv),
b AS (SELECT *, CASE WHEN s > 0 THEN least(3, floor(target / s)) ELSE 0 END AS copies FROM t),
c AS (SELECT d.*, b.s, b.target, b.copies, greatest(0, b.target - b.copies * b.s) AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
             sum(size) OVER (PARTITION BY d.source, hash) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, s AS source_size, target,
       (size * (copies + CASE WHEN upto <= budget OR upto - own < budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END))::BIGINT
       AS taken FROM c
"""


@_query
def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per line of all documents."""
    return tokens.section_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


@_query
def op3_seekable_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back from its bundle."""
    folder = new_path(spark, "archives")
    index = archives.write_archives(_table(spark, sf_dir, "pages"), folder)
    return archives.read_archives(index, folder, with_payload=False).drop("url", "payload")


ORACLES["op3_seekable_archives"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS last FROM p)
SELECT page_id, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, n AS payload_bytes,
       d AS payload_digest, CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""


@_query
def op2_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon learned from labels that are not held out, applied to all documents."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op1_flat_graph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of a label at a cosine of 0.98 and more."""
    return flatgraph.near_vectors(_table(spark, sf_dir, "embeddings"))


ORACLES["op1_flat_graph_near_duplicates"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, c) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


@_query
def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages, and the ten terms that set each apart."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.n, 0) + 2 * v.v) AS p,
             1 + 1000000000::HUGEINT * (k.whole + 2) // (v.n + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE count > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""


@_query
def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their four leading components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op12_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their bytes in strings of 400 bytes that stand somewhere else too."""
    cut = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_deep_shallow_dedup"] = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT r, p, md5(b[p:p + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
m AS (SELECT r, p FROM s SEMI JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
e AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) > 400 AS fresh FROM m),
g AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM e),
x AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY r, run),
y AS (SELECT r, a, z, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS before FROM x),
k AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last FROM x GROUP BY r),
parts AS (SELECT y.r, a AS place, hex(b[before:a - 1]) AS piece FROM y JOIN d USING (r) WHERE a > before
          UNION ALL SELECT r, coalesce(last, 1), hex(CASE WHEN last IS NULL THEN b ELSE b[last:octet_length(b)] END) FROM d LEFT JOIN k USING (r)
          WHERE coalesce(last, 1) <= octet_length(b)),
kept AS (SELECT r, string_agg(piece, '' ORDER BY place) AS whole FROM parts GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(whole, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN kept USING (r)
"""
