"""The queries of this subpackage, one ``opN_<name>`` each, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, langid, licenses, lloyd, packing, pii, quality_gbt, quality_rules, simhash, tiers, url_filter, warc


#: Pages have no capture time: page n is taken as captured n seconds after this one (Unix seconds of 2024-01-01).
FIRST_CAPTURE = 1_704_067_200


def tokenizer_files() -> dict[str, str]:
    """Where the public vocabulary lies; nothing of it is copied."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.col("page_id")))
    return warc.archive_and_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "position")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.identifiers(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), **tokenizer_files())


def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = langid.dictionaries(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, models).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: those of a source lie 64 to a directory, 64 directories to one above; the first of each is its LICENSE."""
    n, name = F.col("doc_id"), F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat("doc_id", F.lit(".txt")))
    upper = F.concat_ws("/", "source", F.floor(n / 4096))
    path = F.when(n % 4096 == 0, F.concat_ws("/", upper, name)).otherwise(F.concat_ws("/", upper, F.floor(n / 64), name))
    return licenses.scan(_table(spark, sf_dir, "documents").withColumn("path", path)).withColumn("licenses", F.array_join("licenses", ","))


def op8_histogram_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: verdict, host, path of the contract's rules.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Families of spam, betting, medicine, tracker and adult hosts, under each domain that they use; a listed host stands for its subdomains too.
URL_LIST = tuple(f"{name}.example.{top}" for name in ("casino-win", "free-bets", "spam-farm", "adult-x", "cheap-pills", "ads-track") for top in ("com", "net", "org"))


def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in URL_LIST], "key string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, listed)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tiers.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.with_figures(lloyd.cluster(_table(spark, sf_dir, "embeddings")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7, the label is one further; anchors are the rows whose vec_id is divisible by 50."""
    n, label = F.col("vec_id"), F.col("label")
    moved = F.when(n % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), n % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


#: A SHA-1 in base 32: four digits from each 20 bits.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(sha1(h), (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"""


def _lloyd_sql(k: int = lloyd.CLUSTERS, rounds: int = lloyd.ROUNDS, dims: int = lloyd.DIMS) -> str:
    """A pair of CTEs a round: the nearest centroids, and the floors of the means."""

    def near(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (SELECT n, vec_id, min({{'d': d, 'c': cluster}}) AS m FROM
            (SELECT e.n, e.vec_id, c.cluster, CAST(sum((e.x - c.x) * (e.x - c.x)) AS BIGINT) AS d FROM e JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY n, vec_id)"""

    def means(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{r} c LEFT JOIN
            (SELECT a.m.c AS cluster, e.i, CAST(sum(e.x) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} a USING (n) GROUP BY ALL) m ON m.cluster = c.cluster AND m.i = c.i)"""

    steps = ", ".join(f"{near(r)}, {means(r)}" for r in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({lloyd.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
               WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
             e AS MATERIALIZED (SELECT n, vec_id, unnest(range({dims})) AS i, unnest(q) AS x FROM v),
             c0 AS MATERIALIZED (SELECT s.cluster, e.i, e.x FROM e JOIN (SELECT n, row_number() OVER (ORDER BY sha256('{lloyd.SEED}:' || vec_id), q) - 1 AS cluster FROM v QUALIFY cluster < {k}) s USING (n)),
             {steps}, {near(rounds)},
             h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN h ON h.cluster = m.c"""


SQL = {
    "op12_lloyd": _lloyd_sql(),
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
             p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3""",
    "op1_warc_index_merge": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d),
             u AS (SELECT page_id, {FIRST_CAPTURE} + page_id AS captured, regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
             k AS (SELECT page_id, captured, CASE WHEN split_part(rest, '/', 1) = '' THEN ''
                     ELSE array_to_string(list_reverse(string_split(lower(split_part(rest, '/', 1)), '.')), ',') || ')/' || substr(rest, length(split_part(rest, '/', 1)) + 2) END AS urlkey FROM u)
        SELECT m.page_id, payload_bytes, payload_digest,
               CASE WHEN m.page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m.page_id <> last THEN last END AS refers_to, urlkey, captured,
               row_number() OVER (ORDER BY urlkey, captured, m.page_id) - 1 AS position
        FROM m JOIN k ON m.page_id = k.page_id""",
    "op9_bloom_cascade": f"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
             h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
             n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS key FROM h),
             r AS (SELECT *, CASE
                     WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                     WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM n)
        SELECT page_id, host, path, rule, CASE
                 WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                 WHEN {' OR '.join(f"key = '{x}' OR key LIKE '%.{x}'" for x in URL_LIST)} THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
