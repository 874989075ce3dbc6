"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import WORD


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), tokenizer_path(), limit=512)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir, "documents"))


def op4_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from ._common import shared_folder
    from .slots import shard

    return shard(_read(spark, sf_dir, "documents"), 24, map_path=f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op7_pq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq_dedup import embedding_dedup

    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(_read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of squares beyond a long are null in ``deviation`` and stand in ``deviation_exact``."""
    from .whitening import whiten

    rows = whiten(_read(spark, sf_dir, "embeddings"))
    exact = F.col("deviation")
    fits = (exact <= F.lit(2**63 - 1).cast("decimal(38,0)"))
    return rows.withColumn("deviation_exact", exact).withColumn("deviation", F.when(fits, exact).cast("long"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    rows = repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with runs planted in a tenth of them by their ids' checksums, as the contract fixes; null ids have none."""
    from .periodic import periodic_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    docs = docs.withColumn("n", F.when(F.col("h") % 10 == 0, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))).otherwise(0).cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("1 + int((n - a) div (3 + g % 8))"))
    words, rest = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    planted = F.concat_ws(" ", F.slice(words, F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    rows = periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = rows.withColumn("best", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-best.less * 1000) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_OP2_SQL = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
from t
"""

QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_hilbert_packing, op4_slots, op5_minhash, op6_mixing, op7_pq_embeddings, op8_token_counts, op9_html_text, op10_secret_scan, op11_whitening, op12_repeats, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op2_exact_dedup": _OP2_SQL}
