"""The registered queries ``opN_<name>`` and their SQL; thin wrappers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.decontamination import contamination
from tidelog.llm.embedding_dedup import embedding_components
from tidelog.llm.html_text import main_texts
from tidelog.llm.license_scan import license_matches
from tidelog.llm.ngram_join import jaccard_components
from tidelog.llm.sentencepiece import piece_tokens
from tidelog.llm.substring_dedup import dedup_substrings
from tidelog.llm.suffix_tree import suffix_tree_scores
from tidelog.llm.toxicity import train_and_score
from tidelog.llm.url_filter import RULES, SOFT, SOFT_DISTINCT, STRICT, url_verdicts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(read(spark, sf_dir, "documents"), depth=3)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens(read(spark, sf_dir, "documents"), digests_only=True)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages")).drop("strict_terms", "soft_terms")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = train_and_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "starts", "ends")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def _op8_sql() -> str:
    """Hosts, paths and rules by patterns; terms by a search for each, between boundaries."""
    hit = " + ".join("CASE WHEN regexp_matches(s, '(^|[^a-z0-9]){}([^a-z0-9]|$)') THEN {} ELSE 0 END".format(t, w) for w, terms in ((SOFT_DISTINCT, STRICT), (1, [t for t in SOFT if t not in STRICT])) for t in terms)
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule, action = (" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{then}'" for h, p, then in kind) for kind in ([(h, p, h + p) for _, h, p in by_length], [(h, p, a) for a, h, p in by_length]))
    return f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    v AS (SELECT *, host || lower(path) AS s FROM u)
    SELECT page_id, host, path, CASE {rule} END AS rule, CASE {action} WHEN {hit} >= {SOFT_DISTINCT} THEN 'block' ELSE 'allow' END AS verdict FROM v"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP1 = f"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORDS}), []) AS words FROM documents),
 g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
 f AS (SELECT gram, min(doc_id) AS source FROM g GROUP BY gram),
 p AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
 m AS (SELECT p.doc_id, p.i, p.word, max(CASE WHEN f.source < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
   FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i LEFT JOIN f ON f.gram = g.gram),
 k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

_OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_WORDS}), []) AS words FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
 l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * common >= 90 * (x.n + y.n - common)),
 r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = w.doc_id"""

_OP7 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
 c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id), d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT c.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN d ON d.a = c.vec_id"""

_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP10 = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_ITEM_WORDS}), []) AS words FROM documents),
 b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), {_ITEM_WORDS}), []) AS words FROM benchmark),
 p AS (SELECT DISTINCT item_id, least(len(words), 13) AS m, array_to_string(words[i:i + 12], ' ') AS gram FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 11, 2))) AS i FROM b WHERE len(words) > 0)),
 g AS (SELECT doc_id, m, i, array_to_string(words[i:i + m - 1], ' ') AS gram FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(words) >= m)),
 h AS (SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p ON p.m = g.m AND p.gram = g.gram),
 c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
 FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

ORACLE: dict[str, str] = {"op1_substring_dedup": _OP1, "op4_ngram_join": _OP4, "op7_embedding_dedup": _OP7, "op8_url_filter": _op8_sql(), "op10_decontamination": _OP10}
