"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_groups
from .jaccard_join import jaccard_components
from .language_id import identify
from .licences import scan
from .line_dedup import dedup_lines
from .lm_score import score_texts
from .merkle import verified_rows
from .mixing import mix_rates
from .pieces import encode_and_decode, fallback_count, load
from .quality import quality
from .substring_dedup import dedup_substrings
from .topk_search import quantised, top_k
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document; family is that of the first confirmed one."""
    out = scan(_table(spark, sf_dir, "documents"))
    confirmed = F.filter("hits", lambda h: h["family"] != "unknown")
    return out.select(
        "doc_id", "n_paragraphs", F.size("hits").alias("n_licences"), F.size(confirmed).alias("n_confirmed"),
        F.coalesce(F.get(confirmed, F.lit(0))["family"], F.when(F.size("hits") > 0, F.lit("unknown")).otherwise(F.lit("none"))).alias("family"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))).alias("families"),
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, counted and hashed, and whether decoding gives the text back."""
    out = encode_and_decode(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.coalesce(F.size("pieces"), F.lit(0)).alias("n_pieces"), fallback_count(F.col("pieces"), load()).alias("n_byte_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"), F.col("text").eqNullSafe(F.col("back")).alias("lossless"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages."""
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words a shingle, 85 per cent."""
    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, per=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources."""
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 bytes."""
    return dedup_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_rows(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_topk_search": op2_topk_search,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_score": op10_lm_score,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_whitening": op13_embedding_whitening,
}



def _merkle_sql(levels: int = 8, top: int = 4) -> str:
    """SQL of operator 12 for up to 8 ** levels rows of a language and 8 ** top languages; every level is a table of its own here."""

    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = [
        # CRC-32 of the id as text, a byte at a time with its table of 256 entries
        "t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        "c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),"
        " lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM documents, t)",
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('altered')} AS altered FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, '{letters}', '{letters.lower()}') ELSE text END AS altered FROM c))",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, altered AS h, '' AS proof FROM d)",
        "a0 AS (SELECT lang, p, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM f0)",
    ]

    def level(nodes: str, rows: str, k: int, key: str) -> None:
        """The level above of the nodes, and the rows folded so far."""
        parts.append(f"{nodes}r{k} AS (SELECT {key}, p // 8 AS b, list(h ORDER BY p) AS hs, max(n) AS n FROM {nodes}{k} GROUP BY {key}, p // 8)")
        parts.append(f"{nodes}{k + 1} AS (SELECT {key}, b AS p, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n FROM {nodes}r{k})")
        before, after = "array_to_string(r.hs[1:f.p % 8], '')", "array_to_string(r.hs[f.p % 8 + 2:], '')"
        parts.append(
            f"{rows}{k + 1} AS (SELECT f.* REPLACE (f.p // 8 AS p, CASE WHEN r.n > 1 THEN sha256({before} || f.h || {after}) ELSE f.h END AS h, CASE WHEN r.n > 1 THEN f.proof || {before} || {after} ELSE f.proof END AS proof)"
            f" FROM {rows}{k} f JOIN {nodes}r{k} r ON f.{key} IS NOT DISTINCT FROM r.{key} AND f.p // 8 = r.b)"
        )

    for k in range(levels):
        level("a", "f", k, "lang")
    parts.append(f"s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM a{levels})")
    parts.append("b0 AS (SELECT 1 AS one, p, subroot AS h, count(*) OVER () AS n FROM s)")
    parts.append(f"g0 AS (SELECT 1 AS one, doc_id, leaf, subroot, s.p, f.h, f.proof FROM f{levels} f JOIN s ON f.lang IS NOT DISTINCT FROM s.lang)")
    for k in range(top):
        level("b", "g", k, "one")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM b{top}) AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = (SELECT h FROM b{top}) AS verified FROM g{top}"


ORACLES: dict[str, str] = {
    "op12_merkle_manifest": _merkle_sql(),
    "op2_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_line_dedup": """
        WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        e AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
        host AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
        f AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM e
              WHERE NOT regexp_full_match(line, '[ \\t\\r\\x0b\\x0c]*') GROUP BY source, line),
        bad AS (SELECT f.source, f.line FROM f JOIN host ON f.source IS NOT DISTINCT FROM host.source
                WHERE pages >= 5 AND pages > 0.02 * host_pages),
        m AS (SELECT e.doc_id, e.line, e.i, bad.line IS NOT NULL AS dropped FROM e
              LEFT JOIN bad ON e.source IS NOT DISTINCT FROM bad.source AND e.line = bad.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS text_sha256
        FROM m GROUP BY doc_id
    """,
}
