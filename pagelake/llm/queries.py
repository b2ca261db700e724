"""The registered queries of the numbered operators, with their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import centroids, fingerprints, id_files, language_id, line_dedup, minhash_dedup, mixing, ngram_join, packing, quality_rules, source_divergence, token_counts, url_filters
from pagelake.session import work_path


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, d), public_tokenizers.path("byte_bpe_50k.json"))


def op2_pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(_documents(spark, d))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             CAST(3 * source_size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS place, sum(cap) OVER r - cap AS cap_before, sum(weight) OVER r - weight AS weight_before,
             (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total, (SELECT sum(weight) FROM w) AS weights
      FROM w WINDOW r AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total - cap_before) / CAST(weights - weight_before AS DOUBLE) AS level FROM o),
f AS (SELECT level AS shared, place AS free FROM l WHERE NOT weight * level > cap ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN place < free THEN cap ELSE weight * shared END AS target FROM l, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
g AS (SELECT source, u, doc_id, size, count(*) AS k FROM d GROUP BY source, u, doc_id, size),
e AS (SELECT g.*, n.source_size, n.target, n.repeats, CAST(round(n.target - n.repeats * n.source_size) AS BIGINT) AS need,
             sum(size * k) OVER (PARTITION BY g.source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) - size * k AS start
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
x AS (SELECT *, CAST(greatest(0, least(size * k, need - start)) AS BIGINT) // k AS extra FROM e)
SELECT d.doc_id, d.size, x.source_size, x.target, x.repeats, CAST(x.extra AS BIGINT) AS extra_words,
       CAST(d.size * x.repeats + x.extra AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.size = x.size
"""


def held_out(docs: DataFrame):
    """Whether a row is kept from the fit: a quarter of the ids by their checksum."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    model = language_id.fit_languages(docs.filter(~held_out(docs)), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.identify(docs, model, {"held_out": held_out(docs)})


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, d))


def op6_token_id_files(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "token-ids")
    id_files.write_ids(_documents(spark, d), path, public_tokenizers.path("byte_bpe_50k.json"))
    return id_files.read_ids(spark, path, with_ids=False)


def op7_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return url_filters.url_filters(spark.read.parquet(f"{d}/pages.parquet"))


def op8_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edit_likeness(_documents(spark, d))


def op9_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.ngram_join(_documents(spark, d))


# all pairs of documents that share a shingle
OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n AS x ON p.a = x.doc_id JOIN n AS y ON p.b = y.doc_id
  WHERE 100 * p.shared >= 75 * (x.size + y.size - p.shared)),
r AS (
  SELECT doc_id, doc_id AS reached FROM w
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT w.doc_id, CAST(coalesce(n.size, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) AS c ON w.doc_id = c.doc_id
"""


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = line_dedup.line_dedup(_documents(spark, d))
    return found.select("doc_id", "n_pieces", "removed_pieces", F.md5("text").alias("text_md5"))


# all windows of lines and sentences by their content, without fingerprints; a mark stands where a text is cut
OP10_SQL = r"""
WITH o AS (SELECT doc_id, regexp_replace(text, '(\n)([^\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, regexp_replace(t, '([.!?] )([^\x20\x09-\x0D\x01])', '\1' || chr(1) || '\2', 'g') AS t FROM o),
s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?] )([^\x20\x09-\x0D\x01])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS pieces FROM p),
x AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM s),
a AS (SELECT *, len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+')) AS words, regexp_replace(piece, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS inner_ FROM x),
b AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS until FROM a WHERE words > 0),
c AS (SELECT *, until - words AS start FROM b),
w AS (
  SELECT doc_id, pos AS first, max(pos) OVER f AS last, list(inner_) OVER f AS content, max(until) OVER f - start AS total
  FROM c WINDOW f AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER g, pos, list(inner_) OVER g, until - min(start) OVER g
  FROM c WINDOW g AS (PARTITION BY doc_id ORDER BY until RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)),
k AS (SELECT doc_id, first, last, content FROM w WHERE total >= 10),
m AS (SELECT content, min({'d': doc_id, 'f': first}) AS place FROM k GROUP BY content),
r AS (SELECT DISTINCT k.doc_id, k.first, k.last FROM k JOIN m ON k.content = m.content
      WHERE {'d': k.doc_id, 'f': k.first} > m.place),
z AS (SELECT DISTINCT x.doc_id, x.pos FROM x JOIN r ON x.doc_id = r.doc_id AND x.pos BETWEEN r.first AND r.last),
t AS (SELECT x.doc_id, string_agg(x.piece, '' ORDER BY x.pos) FILTER (WHERE z.pos IS NULL) AS kept, count(z.pos) AS removed
      FROM x LEFT JOIN z ON x.doc_id = z.doc_id AND x.pos = z.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(s.pieces), 0) AS BIGINT) AS n_pieces, CAST(coalesce(t.removed, 0) AS BIGINT) AS removed_pieces,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t.kept, '')) END AS text_md5
FROM documents AS d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op11_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return source_divergence.source_divergence(_documents(spark, d))


# every kept term of a language with every group and pair of groups
OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS whole FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(whole) AS HUGEINT) AS total FROM k GROUP BY lang),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.whole
      FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM m GROUP BY lang, source),
p AS (SELECT m.lang, m.source, m.term, m.n,
             1 + (CAST(1000000000 AS HUGEINT) * (m.n + 5)) // (s.total + 5 * l.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (m.whole + 5)) // (l.total + 5 * l.v) AS q
      FROM m JOIN s ON m.lang = s.lang AND m.source = s.source JOIN l ON m.lang = l.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def op12_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{d}/embeddings.parquet"))


def _op12_sql() -> str:
    """Lloyd's rounds with every distance, one step after the other."""
    distance = "CAST(list_sum(list_transform(list_zip(v.c, k.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64)""",
        """k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), c) - 1 AS cluster, c FROM v
  QUALIFY cluster < 16)""",
    ]
    for i in range(4):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {distance}, 'k': k.cluster}}) AS m FROM v, k{i} AS k GROUP BY r)")
        if i < 3:
            steps.append(f"""e{i} AS (SELECT m.k AS cluster, unnest(v.c) AS x, unnest(range(64)) AS i FROM a{i} JOIN v USING (r)),
s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM e{i} GROUP BY cluster, i),
n{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY cluster),
k{i + 1} AS MATERIALIZED (SELECT k{i}.cluster, coalesce(n{i}.c, k{i}.c) AS c FROM k{i} LEFT JOIN n{i} ON k{i}.cluster = n{i}.cluster)""")
    return "WITH " + ",\n".join(steps) + """
SELECT v.vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance,
       CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k3.c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN k3 ON k3.cluster = m.k
"""


def op13_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(_documents(spark, d))


# the links of the n-gram join's SQL with other shingles and threshold
OP13_SQL = f"""
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM (
{OP9_SQL.replace("i : i + 4", "i : i + 3").replace("len(words) - 4", "len(words) - 3").replace("75 *", "80 *")}
)
"""


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_pack_sequences": (op2_pack_sequences, None),
    "op3_mix_sources": (op3_mix_sources, OP3_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_quality_rules": (op5_quality_rules, None),
    "op6_token_id_files": (op6_token_id_files, None),
    "op7_url_filters": (op7_url_filters, None),
    "op8_fingerprints": (op8_fingerprints, None),
    "op9_ngram_join": (op9_ngram_join, OP9_SQL),
    "op10_line_dedup": (op10_line_dedup, OP10_SQL),
    "op11_source_divergence": (op11_source_divergence, OP11_SQL),
    "op12_centroid_clusters": (op12_centroid_clusters, _op12_sql()),
    "op13_minhash_dedup": (op13_minhash_dedup, OP13_SQL),
}
