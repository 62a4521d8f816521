"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = documents(spark, sf_dir)
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    out = near_duplicates(documents(spark, sf_dir), shingle=3, radius=2)
    return out.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    out = pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), ranks_file=tokenizer("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, tiers=(2048, 1024, 512, 256), eos=1)
    return out.withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    out = token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), limit=4096)
    return out.withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import QualityModel

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = QualityModel(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "quality"))
    return model.judge(docs, "").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import TARGETS, copies, mix, quality_domains

    rows, domains, _, _ = mix(documents(spark, sf_dir), quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS, ["doc_id"])
    shares = F.map_from_arrays(F.array(*map(F.lit, domains)), F.transform("_qw_posteriors", lambda p: p / 100.0))
    return rows.select("doc_id", F.col("_qw_tokens").alias("n_tokens"), shares.alias("posteriors"), F.round("_qw_rate", 6).alias("rate"), copies().alias("copies"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import classes_of_lines, mark_lines, removed

    marked = mark_lines(documents(spark, sf_dir).select("doc_id", "text"))
    firsts = F.transform(F.filter("_qw_lines", lambda x: ~x["kept"]), lambda x: x["first_id"])
    return marked.select(
        "doc_id",
        F.col("_qw_n_lines").alias("n_lines"),
        F.size(removed()).cast("long").alias("n_removed"),
        removed().alias("removed"),
        F.coalesce(F.sort_array(F.array_distinct(firsts)), F.array().cast("array<bigint>")).alias("first_docs"),
        classes_of_lines().alias("classes"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 20 = 0")
    out = search(documents(spark, sf_dir), asked.select(F.col("item_id").alias("query_id"), "text"), k=10)
    return out.withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH cut AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
stats AS (SELECT count(*) AS n, sum(len(w))::DOUBLE / count(*) AS average FROM cut),
asked AS (SELECT item_id AS query_id, w AS term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM cut) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
idf AS (SELECT term, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), stats),
impact AS (SELECT doc_id, term, floor(1e6::DOUBLE * idf * tf::DOUBLE * 2.2::DOUBLE / (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / average)) + 0.5::DOUBLE)::BIGINT AS impact FROM tf JOIN idf USING (term), stats),
scored AS (SELECT query_id, doc_id, sum(times * impact)::BIGINT AS score FROM impact JOIN asked USING (term) GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    docs = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(docs)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE, scan

    found = scan(documents(spark, sf_dir))
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, base),
        F.sha2(listed(kept), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_packing, op4_token_counts, op5_quality, op6_mixing, op7_line_dedup, op8_topk, op9_licenses, op10_secrets)}

ORACLES: dict[str, str] = {"op8_topk": OP8_SQL}
