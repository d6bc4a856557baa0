"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, tidy
from .surrogates import checked_surrogates

#: The key of these queries; a deployment passes its own secret.
KEY = b"surrogate key of the registered queries"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    n = F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, x: a + x)
    kinds = F.array_join(F.transform(F.map_entries("pii"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return out.select("doc_id", "text", n.alias("n_entities"), kinds.alias("kinds"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks, leak_report

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_report(find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import class_scores

    return class_scores(table(spark, sf_dir, "documents"), "doc_id", "text", folds=7, out_fold=2)


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import page_texts

    return page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: A document with at least this probability is rejected.
TOXIC = 0.5


def label_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table's two judgements as the chain's categories; it has one category of toxicity."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, label_categories(spark, sf_dir), ["low_quality", "toxic"])
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC).alias("toxic"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_links

    return vector_links(table(spark, sf_dir, "embeddings"), threshold=0.95)


@tidy
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import find_secrets

    out = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != "net")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


@tidy
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import folded, leaf_hash, manifest, siblings_hash

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = {c: F.col(c) for c in fields} | {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf_hash(*changed.values()))
    out = manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", fields, carry=tampered)
    again = folded(F.coalesce("carried", "leaf"), F.col("proof")).alias("folded_root")
    out = out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_hash(F.col("proof")).alias("proof_sha256"), again)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@tidy
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hashlib import sha256

    from .base import cut
    from .vector_codes import vector_codes, with_group_error

    coded, books = vector_codes(table(spark, sf_dir, "embeddings"), keep=("label",), parts=16, entries=64, rounds=2)
    out = with_group_error(cut(coded), "label")
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
