"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilngraph.llm import alignment, decontam, html_extract, license_scan, media_ogg, mixing, quality, simhash, suffix_dedup, token_files, url_filter, vector_codes, warc
from kilngraph.llm._util import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


def op6_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.ogg_features(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_filter.dated_captures(pages), url_filter.sample_lists(pages))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_tokens(table(spark, sf_dir, "documents"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_suffix_dedup, op2_license_scan, op3_simhash, op4_decontaminate, op5_quality_classifier, op6_media_ogg, op7_mixing, op8_html_extract, op9_url_filter, op10_warc)
    return {f.__name__: f for f in (*first, op11_token_files, op12_align_tokenizers, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9, "op10_warc": OP10, "op13_vector_codes": OP13}


def drawn(key: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) % {n})"


def listed(name: str, kind: str, share: int, value: str, where: str = "true") -> str:
    days = [drawn(f"'{name}|{k}|' || value", n) for k, n in ((1, 200), (2, 90), (3, 60))]
    source = f"(SELECT DISTINCT {value} AS value FROM u WHERE host <> '' AND {where})"
    return f"SELECT '{name}' AS list, '{kind}' AS kind, value, {days[0]} AS a, {days[1]} AS b, {days[2]} AS c FROM {source} WHERE {drawn(f"'{name}|' || value", 10)} < {share}"


OP9 = rf"""
WITH u AS (SELECT page_id, url, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
  coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched FROM pages),
e AS ({listed("spam", "domain", 5, "host")}
  UNION ALL {listed("phishing", "domain", 2, "regexp_replace(host, '^[^.]*[.]', '')")}
  UNION ALL {listed("adult", "prefix", 4, "host || regexp_extract(path, '^(/[^/]*/)', 1)", "regexp_extract(path, '^(/[^/]*/)', 1) <> ''")}),
i AS (SELECT list, kind, value, DATE '2024-01-01' + CAST(a AS INT) AS since, DATE '2024-01-01' + CAST(a + 1 + b AS INT) AS until FROM e
  UNION ALL SELECT list, kind, value, DATE '2024-01-01' + CAST(a + b + c + 2 AS INT), NULL FROM e),
h AS (SELECT u.page_id, u.url, list, value, since, count(*) OVER (PARTITION BY u.page_id, u.url) AS n, row_number() OVER (PARTITION BY u.page_id, u.url ORDER BY length(value) DESC, list, value, since) AS r
  FROM u JOIN i ON u.host <> '' AND CASE kind WHEN 'domain' THEN u.host = value OR ends_with(u.host, '.' || value) ELSE starts_with(u.host || u.path, value) END
  AND fetched >= since AND (until IS NULL OR fetched < until))
SELECT u.page_id, u.url, u.host, strftime(u.fetched, '%Y-%m-%d') AS fetched, h.n IS NOT NULL AS blocked, coalesce(h.n, 0) AS n_entries, h.list, h.value AS entry, strftime(h.since, '%Y-%m-%d') AS since
FROM u LEFT JOIN h ON u.page_id = h.page_id AND u.url = h.url AND h.r = 1
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def assigned(k: int) -> str:
    """n{k}: each part's nearest entry of c{k}."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    near = f"SELECT vec_id, label, p.part, x, e, d, row_number() OVER (PARTITION BY vec_id, p.part ORDER BY d, e) AS r FROM (SELECT vec_id, label, p.part, x, e, {distance} AS d FROM p JOIN c{k} ON p.part = c{k}.part) p"
    return f"n{k} AS (SELECT vec_id, label, part, x, e, d FROM ({near}) WHERE r = 1)"


def moved(k: int) -> str:
    """c{k}: the entries after a round."""
    means = f"SELECT part, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM n{k - 1} CROSS JOIN (SELECT unnest(range(1, w + 1)) AS i FROM width) GROUP BY 1, 2, 3"
    return f"c{k} AS (SELECT part, e, coalesce(m, c) AS c FROM c{k - 1} LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS m FROM ({means}) GROUP BY 1, 2) USING (part, e))"


OP13 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // 16 AS w FROM k), p AS (SELECT vec_id, label, part, v[part * w + 1:(part + 1) * w] AS x FROM k CROSS JOIN width CROSS JOIN (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
{assigned(0)}, {moved(1)}, {assigned(1)}, {moved(2)}, {assigned(2)},
o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY 1, 2),
s AS (SELECT sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY part, e, i)) AS digest FROM (SELECT part, e, unnest(c) AS m, generate_subscripts(c, 1) AS i FROM c2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM o CROSS JOIN s
"""
