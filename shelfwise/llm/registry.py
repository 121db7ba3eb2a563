"""Queries opN_<name> of this subpackage over whole tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.decontaminate import contaminated
from shelfwise.llm.infill import fill_in_middle
from shelfwise.llm.licenses import scan_licenses
from shelfwise.llm.lines import drop_repeated_lines
from shelfwise.llm.minhash import near_duplicates
from shelfwise.llm.mixing import mix_sources
from shelfwise.llm.neighbours import nearest_neighbours
from shelfwise.llm.quotes import reply_order
from shelfwise.llm.secrets import scan_secrets
from shelfwise.llm.suffixes import remove_repeats
from shelfwise.llm.tables import table
from shelfwise.llm.topk import top_k
from shelfwise.llm.toxicity import score_toxicity
from shelfwise.llm.variants import spelling_variants

Query = Callable[[SparkSession, str], DataFrame]


def label_weights(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 0.5 for poor ones."""
    weight = F.when(F.max("quality") == 1, 2.0).when(F.max("quality") == 0, 0.5).otherwise(1.0)
    return table(spark, folder, "labels").groupBy("doc_id").agg(weight.alias("weight"))


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quote_links(spark: SparkSession, folder: str) -> DataFrame:
    return reply_order(table(spark, folder, "conversations")).select(
        "conv_id", "turn", "role", "reply_text", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth"
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op6_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op8_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), label_weights(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", "text"
    )


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle(table(spark, folder, "documents")).drop("output")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Query] = {
    "op1_top_k": op1_top_k,
    "op2_quote_links": op2_quote_links,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_passages": op6_benchmark_passages,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_repeated_bytes": op8_repeated_bytes,
    "op9_mix_sources": op9_mix_sources,
    "op10_line_templates": op10_line_templates,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
SQL: dict[str, str] = {
    "op1_top_k": """
        WITH kept AS (
            SELECT row_number() OVER () AS place, vec_id,
                   list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ),
        scored AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id,
                   list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM kept q JOIN kept c ON q.place <> c.place AND len(q.v) = len(c.v)
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY place ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    "op11_fill_in_middle": """
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
                   sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
            FROM documents
        ),
        drawn AS (
            SELECT *, len(units)::BIGINT AS n,
                   list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(hex, i, 8))::BIGINT) AS h
            FROM cut
        ),
        formed AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                             OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ),
        parts AS (
            SELECT *, array_to_string(units[1:low], '') AS prefix,
                   array_to_string(units[low + 1:high], '') AS middle,
                   array_to_string(units[high + 1:], '') AS suffix
            FROM formed
        )
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text
                      WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
        FROM parts
    """,
}
