"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, html_text, jaccard_join, license_scan, mixing, quality, sharding, substring_dedup, token_files, url_filter, warc, whitening
from .common import n_words, saved, scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    token_files.encode_corpus(table(spark, sf_dir, "documents"), folder, tokenizer_path(), 2)
    return token_files.documents(spark, folder)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = saved(quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "counts")
    rules = quality.fit(counted, table(spark, sf_dir, "labels"))
    return quality.judged(counted, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents are preferred, by the root of their words."""
    size = n_words(F.col("text"))
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), size, preference=F.sqrt(size))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "probability")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents")).select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write(warc.planned(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    return warc.read(spark, paths, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct("findings.license"))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"), F.round(F.array_max("findings.reduction"), 6).alias("reduction"), F.array_max("findings.rank").alias("worst_rank"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    dealt = sharding.shard(rows, "doc_id", [1.0] * 8, order=("text_crc32", "size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.rendezvous(F.col("doc_id"), [1.0] * 9).alias("grown_shard"))


#: The rules of the query, host, path and action.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that 64 bits can't hold is null; ``deviation_exact`` has it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.fit(rows)
    error = whitening.identity_error(rows, found) if found else 0.0
    white = whitening.transform(rows, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.lit([float(v / found.trace) for v in found.values] if found else []).cast("array<double>")
    return white.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))
    return found.rows.select("vec_id", "cluster", "distance", of(found.inertia, "bigint").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), of(found.digests(), "string").alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_html_text, op3_substring_dedup, op4_quality_rules, op5_mixing, op6_decontaminate, op7_jaccard_join, op8_warc, op9_license_scan, op10_sharding, op11_url_filter, op12_whitening, op13_centroids)}


_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP3 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), {_WORDS}) AS w FROM documents),
 l AS (SELECT doc_id, list_transform(range(1, len(w)-11), lambda i: array_to_string(w[i:i+12], ' ')) AS runs FROM d),
 r AS (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM l),
 f AS (SELECT run, min(doc_id) AS first FROM r GROUP BY run),
 h AS (SELECT DISTINCT doc_id, i+k AS pos FROM r JOIN f USING (run), range(13) t(k) WHERE first < doc_id),
 p AS (SELECT doc_id, list(pos) AS gone FROM h GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)"""

_OP6 = rf"""WITH e AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 it AS (SELECT id, w, least(len(w), 10) AS s FROM e WHERE len(w) > 0),
 b AS (SELECT DISTINCT id, s, unnest(list_transform(range(1, len(w)-s+2), lambda i: array_to_string(w[i:i+s-1], ' '))) AS run FROM it),
 d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 l AS (SELECT doc_id, s, list_transform(range(1, greatest(len(w)-s+2, 1)), lambda i: array_to_string(w[i:i+s-1], ' ')) AS runs FROM d, (SELECT DISTINCT s FROM it)),
 r AS (SELECT doc_id, s, unnest(runs) AS run, generate_subscripts(runs, 1) AS i FROM l),
 h AS (SELECT doc_id, s, i, id FROM r JOIN b USING (s, run)),
 n AS (SELECT doc_id, count(DISTINCT i+k) AS n_hit FROM h, range(10) t(k) WHERE k < s GROUP BY doc_id),
 g AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids FROM h GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""

_OP7 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w)-3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM d),
 u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM c WHERE 100*k >= 75*(na+nb-k)),
 z AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT z.a, e.b FROM z JOIN e ON z.b = e.a)
 SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, (SELECT min(b) FROM z WHERE z.a = s.doc_id) AS component_id FROM s"""

_OP8 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html,'')) AS BIGINT) AS n, sha256(coalesce(html,'')) AS d FROM pages), f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
 SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN f USING (d)"""


#: Hashes, scores and slots as in ``sharding``; the crc32 goes over the UTF-8 bytes, by a table of 256 numbers made here.
_OP10 = r"""WITH b AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crc),
 d AS (SELECT row_number() OVER () AS n, doc_id, CAST(strlen(coalesce(text,'')) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text,''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
 c AS (SELECT n, doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc[xor(a, x) % 256 + 1]), 4294967295), 4294967295) AS text_crc32 FROM d, b),
 k AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '~') AS key FROM c),
 r AS (SELECT *, list_transform(range(9), lambda i: (-1.0) / ln((CAST('0x' || substr(md5(key || '/' || i), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) AS scores, CAST('0x' || substr(md5(key || '/slot'), 1, 13) AS BIGINT) % 1024 AS bucket FROM k),
 s AS (SELECT *, CAST(list_position(scores[1:8], list_max(scores[1:8])) - 1 AS INT) AS shard, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS grown_shard FROM r)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


_OP11 = """WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
 h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
 r AS (SELECT * FROM (VALUES %s) t(rule_host, rule_path, action))
 SELECT p.page_id, p.host, p.path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, coalesce(max_by(action, length(rule_host || rule_path)), 'allow') AS verdict
 FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL""" % ", ".join(map(str, URL_RULES))


def _op13(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    nearest = f"SELECT vec_id, x, min(struct_pack(d := list_sum(list_transform(range(1, {dims} + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), j := j)) AS m FROM v, %s GROUP BY vec_id, x"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings"
        f" WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)",
        f"k0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY draw) - 1 AS INT) AS j, x AS c FROM (SELECT sha256('3:' || vec_id) AS draw, x FROM v ORDER BY draw LIMIT {k}))",
    ]
    for t in range(rounds):
        steps.append(f"a{t} AS MATERIALIZED ({nearest % f'k{t}'})")
        steps.append(f"s{t} AS MATERIALIZED (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT m.j AS j, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t}, range(1, {dims} + 1) t(i) GROUP BY ALL) GROUP BY j)")
        steps.append(f"k{t + 1} AS MATERIALIZED (SELECT k.j, coalesce(s.c, k.c) AS c FROM k{t} k LEFT JOIN s{t} s USING (j))")
    steps.append(f"a AS MATERIALIZED ({nearest % f'k{rounds}'})")
    return f"""WITH {", ".join(steps)} SELECT vec_id, j AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
 CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a JOIN k{rounds} ON j = m.j"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express; tests hold the others against brute force."""
    return {"op3_substring_dedup": _OP3, "op6_decontaminate": _OP6, "op7_jaccard_join": _OP7, "op8_warc": _OP8, "op10_sharding": _OP10, "op11_url_filter": _OP11, "op13_centroids": _op13()}
