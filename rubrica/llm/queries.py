"""One registered query for each operator of this folder, with SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import (
    chat,
    decontaminate,
    exact_dedup,
    langid,
    lexical_search,
    license_scan,
    packing,
    pii,
    simhash_dedup,
    slots,
    token_alignment,
    token_counts,
    toxicity,
)
from rubrica.llm.shared import checkpoint_folder, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(r"""
    WITH words AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
    ), doc_shingles AS (
        SELECT DISTINCT doc_id, unnest([w[i : i + 4] FOR i IN range(1, len(w) - 3)]) AS s FROM words WHERE len(w) >= 5
    ), item_words AS (
        SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
    ), item_shingles AS (
        SELECT DISTINCT item_id, unnest([w[i : i + 4] FOR i IN range(1, len(w) - 3)]) AS s FROM item_words WHERE len(w) >= 5
    ), sizes AS (
        SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
    ), shared AS (
        SELECT doc_id, item_id, count(*) AS n_shared
        FROM doc_shingles JOIN item_shingles USING (s) GROUP BY doc_id, item_id
    )
    SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
    FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item
""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items of which at least four fifths of the shingles are in a document."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query()
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose SimHash differs in at most 4 bits."""
    groups = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_dedup.hex_fingerprint().alias("fingerprint"), "component_id")


@query("""
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score"
    )


_ESCAPED = r"""(len(regexp_extract_all({0}, '\[\\*/?(INST|ROLE)\]|<\\*/?s>')))"""


@query(rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), formatted AS (
        SELECT *, length(text) + {_ESCAPED.format("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
            ELSE 17 + length(role) + {_ESCAPED.format("role")} END AS chars
        FROM turns
    )
    SELECT conv_id,
           count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM formatted GROUP BY conv_id
""")
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back; -1 holds control strings as texts."""
    own = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    added = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_turns(rows.unionByName(added)))


@query()
def op9_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of nearly equal bytes."""
    folder = f"{checkpoint_folder(spark)}/slot-maps/{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"
    placed, _ = slots.assign_shards(table(spark, sf_dir, "documents"), 40, map_folder=folder)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    spans, _ = pii.find_spans(table(spark, sf_dir, "documents"))
    return pii.summary(spans)


@query()
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered templates of every document."""
    return license_scan.summary(license_scan.find_licenses(table(spark, sf_dir, "documents")))


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers."""
    return token_alignment.align(table(spark, sf_dir, "documents"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(rf"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
    ), corpus AS (
        SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w)) :: BIGINT AS n_terms FROM docs
    ), items AS (
        SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark
    ), item_terms AS (
        SELECT i, item_id, unnest(w) AS term FROM items
    ), tf AS (
        SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
        WHERE term IN (SELECT term FROM item_terms) GROUP BY r, doc_id, n, term
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) :: BIGINT AS w
        FROM tf, corpus GROUP BY term
    ), scored AS (
        SELECT i, item_id, r, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) :: BIGINT AS score
        FROM tf JOIN weights USING (term) JOIN item_terms USING (term), corpus GROUP BY i, item_id, r, doc_id
    )
    SELECT item_id, rank :: INTEGER AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
    ) WHERE rank <= 10
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every test item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
