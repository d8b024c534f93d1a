"""The corpus pipeline: five stages from raw documents to a mixed training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import decontaminate, leaks, minmax, mixing, toxicity
from inkloom.llm.store import new_path, packed, unpacked, written


# What holds for every stage: all columns but the text travel packed, so columns of any further names (also those that operators use inside)
# pass unchanged; null ids and repeated rows are documents like others unless a stage says more; texts are read whole, whatever
# their length; an empty table gives an empty table.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the lexicon is learned from the labelled ones among them.

    Null and empty texts have the score of a text without terms and stay, as does everything where no label is known.
    """
    lexicon = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(toxicity.score_documents(packed(docs), lexicon).where("score < 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 and more.

    The least row of a class by its columns stays; of rows equal in all columns one. Null and empty texts are in no class and stay.
    """
    classes = minmax.near_duplicates(packed(docs), k=5, percent=80, permutations=64, with_text=True)
    return unpacked(classes.where("chosen"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in windows of the benchmark. Texts without words stay."""
    found = decontaminate.contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unpacked(found.where(~F.col("contaminated")), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind; n_chars follows a changed text. Null texts stay null."""
    found = leaks.secrets(packed(docs), new_path(spark, "ledger"), keys=("doc_id", "text"))
    clean = leaks.redacted(found.withColumn("changed", F.col("text").isNotNull() & (F.size("spans") > 0)))

    def column(name):
        kept = F.col("text") if name == "text" else F.col("doc_id").getField(name)
        return (F.when(F.col("changed"), F.length("text").cast("bigint")).otherwise(kept) if name == "n_chars" else kept).alias(name)
    return clean.select(*map(column, docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size in words, their copies and the words taken.

    Null and empty texts have size 0 and are taken where their source is. Equal rows are taken alike. A column of the documents that is called
    ``size``, ``copies`` or ``taken`` stays, and the mix's own is then ``mix_size`` and so on.
    """
    taken = mixing.mixed_documents(docs)
    own = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "copies", "taken")]
    return taken.select(*(F.col("text") if c == "text" else F.col("doc_id").getField(c).alias(c) for c in docs.columns), *own)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("secrets", redact_secrets), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's result is written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
