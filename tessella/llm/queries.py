"""The queries of this subpackage: each operator with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .embeddings import near_duplicates
from .html_text import extract
from .mixing import mixture
from .ngram_join import similar_groups
from .packing import pack
from .quality import judge_quality
from .suffix_dedup import removed_repeats
from .token_counts import token_counts
from .url_filter import BLOCKED, RULES, judge_urls
from .warc import archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, operator):
    return lambda spark, sf_dir: operator(_table(ship(spark), sf_dir, name))


def queries() -> dict:
    return {
        "op1_legacy_archive": _over("pages", archive),
        "op2_quality_rules": _over("documents", judge_quality),
        "op3_best_fit_packing": _over("documents", pack),
        "op4_embedding_near_dedup": _over("embeddings", near_duplicates),
        "op5_url_filter": _over("pages", judge_urls),
        "op6_html_extraction": _over("pages", extract),
        "op7_suffix_array_dedup": _over("documents", removed_repeats),
        "op8_source_mixing": _over("documents", mixture),
        "op9_token_counts": _over("documents", token_counts),
        "op10_ngram_jaccard_join": _over("documents", lambda docs: similar_groups(docs).select("doc_id", "n_shingles", "component_id")),
    }


_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
g AS (SELECT h, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
  CASE WHEN g.first IS DISTINCT FROM d.page_id AND g.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first IS DISTINCT FROM d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON d.h = g.h AND d.n >= 1000
"""


def _url_sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{what}'" for what, h, p in cases)
    listed = " OR ".join(f"bare = '{x}' OR ends_with(bare, '.{x}')" for x in BLOCKED)
    return f"""
WITH s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^[\\s\\S]*@', ''), ':[0-9]*$', '') AS bare FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_legacy_archive": _WARC_SQL, "op5_url_filter": _url_sql()}
