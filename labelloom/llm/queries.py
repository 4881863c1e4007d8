"""Queries on the operators of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, decontam, langid, licensescan, linededup, lmscore, neardup, packing, pii, quality, spelling, storage, veccode, warc
from labelloom.session import SETTINGS

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside windows of benchmark items."""
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their 4-word shingles."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4).drop("body")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites."""
    return linededup.line_report(_read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    profile = storage.stored(langid.profiles(docs.where(~out)), "profiles")
    return langid.identify(docs, profile).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of all documents."""
    return quality.quality(_read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licensescan.scan(_read(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under counts and the mixed model."""
    out = lmscore.held_out(F.col("doc_id"))
    found = lmscore.scores(_read(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    warc.register(spark)
    path = storage.new_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_archives(spark, path))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = pii.personal_data(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def _with_settings(query: Query) -> Query:
    """``query`` run under the library's session settings."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return query(spark, sf_dir)

    return run


@_with_settings
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the texts they decode to."""
    definition = _tokenizer("byte_bpe_50k.json")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.decode(bpe.encode(docs, definition), definition)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_with_settings
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings with their errors."""
    coded, codebooks = veccode.compress(_read(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks.digest).alias("codebooks_sha256"))


@_with_settings
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of the documents."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> bytes:
    """Content of a public vocabulary file, read where the query is planned."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def queries() -> dict[str, Query]:
    plans = (
        op1_decontaminate, op2_near_duplicates, op3_line_dedup, op4_language, op5_pack, op6_quality, op7_license_scan, op8_lm_scores, op9_warc,
        op10_personal_data, op11_bpe, op12_vector_codes, op13_spelling,
    )
    return {plan.__name__: plan for plan in plans}


def sql() -> dict[str, str]:
    from labelloom.llm.oracles import SQL

    return dict(SQL)
