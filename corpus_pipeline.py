"""A corpus from raw documents: toxicity, near copies, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept. All but the
last return the columns of ``documents``; the last adds the place of each document in the mix. Documents are
told apart by row, not by id, so null and repeated ids lose nothing. In every stage an empty table gives an empty
one, very long texts are read whole, further columns, whatever their names, pass through, and nulls in the columns
that a stage does not read change nothing; its docstring says what else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.base import cut, free_name, release, table, tidy, with_row_number
from tracemill.llm.decontaminate import find_leaks
from tracemill.llm.mixing import mixed
from tracemill.llm.near_dup import near_duplicates
from tracemill.llm.queries import KEY, TOXIC, label_categories
from tracemill.llm.surrogates import checked_surrogates
from tracemill.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go. Null and empty texts have the score of the chain's
    intercepts and stay as long as that is below the bound; repeated rows share a fate. ``low_quality`` comes first
    in the chain, as the label table has no second category of toxicity."""
    scored = toxicity(docs, label_categories(spark, sf_dir), ["low_quality", "toxic"])
    return scored.where(F.col("p_toxic") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of the smallest id stays; null
    ids come last, and rows of one id in the order of the files. Null and empty texts are no copies of each other."""
    at = free_name(docs, "_row")
    rows = cut(with_row_number(docs, at))
    name = F.struct(F.col("doc_id").isNull().cast("int").alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col(at).alias("row"))
    kept = near_duplicates(rows.select(name.alias("name"), "text"), id_col="name").where("kept")
    return rows.join(kept.select(F.col("name.row").alias(at)), at, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, and repeated rows go or
    stay together."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leak.spans") == 0).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars is set to the new text's length. A null text stays null,
    with a null length, and an empty one empty; repeated rows get equal surrogates."""
    return checked_surrogates(docs, KEY).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mix; ``in_mix`` tells how far every source lasts. A null source is one
    of its own; ties among ids go by a hash of the row. Columns named like an added one are replaced."""
    return mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the surrogates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again; what a stage wrote
    on its way, and the stage before it, are deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, tidy(stage)(spark, docs, sf_dir)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
