"""Queries over the provided tables, one for each numbered operator, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 2048
TOKEN_LIMIT = 512
WEIGHTS = [5.0, 2.0, 1.0]
#: Dated entries of a block list: domain, day, category from that day on (None: off the list).
URL_LIST = [
    ("spam-farm.example.org", "2023-11-01", "spam"),
    ("spam-farm.example.org", "2024-06-01", None),
    ("spam-farm.example.org", "2024-08-15", "spam"),
    ("cheap-pills.example.com", "2024-02-10", "pharma"),
    ("ads-track.example.org", "2023-01-01", "ads"),
    ("tionsh.example.net", "2024-03-01", "adult"),
    ("tionsh.example.net", "2024-05-01", "phishing"),
    ("tionsh.example.net", "2024-10-01", None),
    ("blog.tionble.example.com", "2024-01-20", "malware"),
    ("example.net", "2024-11-01", "parked"),
]
FIRST_FETCH = "2024-01-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), CAPACITY, tokenizer_path())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time: page_id deals them over the days of a year."""
    from tidemark.llm.url_filters import filter_urls

    day = F.date_add(F.lit(FIRST_FETCH).cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    entries = spark.createDataFrame(URL_LIST, "domain string, day string, category string")
    entries = entries.select("domain", F.col("day").cast("date").alias("listed_on"), "category")
    return filter_urls(_table(spark, sf_dir, "pages").withColumn("fetched_on", day), entries)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), WEIGHTS)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import interleaved_shards

    return interleaved_shards(_table(spark, sf_dir, "documents"), 40)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.shared import new_path
    from tidemark.llm.token_files import read_digests, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_digests(spark, path)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document or so claims a leaf of its text in lower case."""
    from tidemark.llm.merkle import leaf_digest, merkle_manifest, verified

    fields = lambda text: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", fields(text).alias("leaf"), F.when(tampered, fields(lowered)).alias("claimed"))
    proofs = verified(merkle_manifest(rows, "leaf", "lang", "doc_id", carry=["claimed"]), F.coalesce("claimed", "leaf"))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def damaged_conversations(conversations: DataFrame) -> DataFrame:
    """conversations with faults by the checksum of conversation and turn: rows dropped (column absent), emptied, without `.!?`, twice, or of the user."""
    n = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", F.when(n == 4, "user").otherwise(role).alias("role"), F.when(n == 1, "").when(n == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), n.alias("n"))
    twice = F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("n") == 0).alias("absent"), F.explode(twice).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conversations import repair_reports

    return repair_reports(damaged_conversations(_table(spark, sf_dir, "conversations")), absent=F.col("absent"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_classifier, op3_url_filters, op4_source_mixing, op5_simhash, op6_sharding, op7_exact_dedup, op8_token_files, op9_language_id, op10_quality_rules, op11_merkle_manifest, op12_conversation_repair, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    entries = ", ".join(f"('{d}', DATE '{day}', {f"'{c}'" if c else "NULL"})" for d, day, c in URL_LIST)
    return {
        "op3_url_filters": f"""
            WITH entries(domain, listed_on, category) AS (VALUES {entries}),
            spans AS (SELECT domain, category, listed_on AS since, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS until FROM entries),
            captures AS (
                SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:\\[\\]]+)', 1)), '\\.$', ''), '') AS host,
                       DATE '{FIRST_FETCH}' + CAST(page_id % 365 AS INTEGER) AS at
                FROM pages),
            hits AS (
                SELECT page_id, s.domain, s.category, row_number() OVER (PARTITION BY page_id ORDER BY length(s.domain) DESC) AS k
                FROM captures c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
                 AND c.at >= s.since AND (s.until IS NULL OR c.at < s.until) AND s.category IS NOT NULL)
            SELECT c.page_id, c.host, h.domain, h.category, h.page_id IS NOT NULL AS blocked
            FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.k = 1
        """,
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
    }
