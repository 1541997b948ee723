"""The corpus pipeline: five stages from raw documents to a weighted sample, each a DataFrame of its predecessor's.

quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarine.llm import decontaminate, linededup, mixing, quality, similar
from tessarine.llm._io import cut, scratch, table
from tessarine.llm._labelled import accepted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more, as they are.

    A text is scored whole, however long; null and empty texts have the model's offset as score and stay or go together, as do repeated rows. Without labels of both classes every
    score is 0.5 and all rows stay. Other columns pass through, whatever their names; an empty table gives an empty table.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return accepted(docs, model.score, quality.THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur and without lines repeated word for word (the document of the smallest id keeps its lines); n_chars follows the text.
    Documents that are by and large copies of another keep the lines that they have from it, as the next stage judges copies whole.

    Null texts stay null; a document may end up with an empty text; rows repeated with id and text are one document and lose the same lines; of lines whose documents have null ids only, none
    goes. Very long texts are read whole. Other columns pass through, whatever their names; an empty table gives an empty table.
    """
    out = linededup.line_dedup(docs, copies=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are 0.8 alike or more, as SimHash fingerprints of 512 bits tell.

    Links are transitive. A group keeps its row of the smallest id: of ids that stand for one text if there are any, then of ids of several texts, null ids last; rows of one
    (id, text) are one. So null ids and ids of several texts are as many documents as they have unlinked texts. Null, empty and blank texts are one group. Texts of fewer
    than five words are one shingle; very long texts are read whole. Columns pass through, whatever their names; an empty table gives an empty table.
    """
    rows = docs.select(F.struct(*docs.columns).alias("all"), F.col("doc_id").alias("id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row"))
    repeated = cut(rows.groupBy("id").agg(F.count("*").alias("n"), (F.min("row") != F.max("row")).alias("shared")).where("n > 1 and id is not null"), "repeated")
    shared = repeated.where("shared").select(F.col("id").alias("several"))
    marked = rows.select("id", "row", "text")
    if shared.isEmpty():
        marked = marked.withColumn("several", F.lit(None).cast(docs.schema["doc_id"].dataType))
    else:
        marked = marked.join(shared, marked["id"] == shared["several"], "left")
    rank = F.when(F.col("id").isNull(), 2).when(F.col("several").isNotNull(), 1).otherwise(0)
    found = similar.near_duplicates(marked.select(F.struct(rank.alias("rank"), "id", "row").alias("key"), "text"), key="key")
    kept = cut(found.where(F.col("key") == F.col("component")).select(F.col("key.id").alias("k_id"), F.col("key.row").alias("k_row")).distinct(), "kept")
    out = rows.join(kept, (rows["row"] == kept["k_row"]) & rows["id"].eqNullSafe(kept["k_id"]), "left_semi")
    # copies of a row, null ids among them
    if not repeated.isEmpty() or not rows.where("id is null").isEmpty():
        out = out.dropDuplicates(["id", "row"])
    return out.select("all.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 60 % or more.

    Null and empty texts stay; very long texts are read whole; repeated rows stay or go together; items without words or with a null id match nothing, and without items all rows stay.
    Columns pass through, whatever their names; an empty table gives an empty table.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample by calibrated probabilities, with mix_topic, mix_tokens, mix_weight, mix_probability and mix_repeats: how often a row is to be taken for the sample's tokens to meet their targets.

    Null sources and languages are values of their own; null and empty texts have no tokens and stay by the plain rate if their cell has none; documents of a null id share one chance, repeated
    rows their fate; very long texts are counted whole. A name that docs have already gets underscores behind it. An empty table gives an empty table.
    """
    return mixing.mix(docs, keep_columns=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier, the tilings and the links have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole documents table, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
