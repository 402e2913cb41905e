"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of `documents`, extra ones included; a working column never takes the
name of one of them.

Rows count one by one, also where they share a doc_id: a stage decides on a row
by its text, never on its id alone.  A null text is an empty one to every stage;
it stays (null stays null) and has no tokens.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontam, neardup, pii, toxicity
from trackloom.llm.queries import RANKS
from trackloom.llm.scratch import FILE_TEXTS, Scratch, bounded, few, text_batches


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or that with underscores where `docs` has such a column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _whole_files(docs: DataFrame) -> DataFrame:
    """`docs` in no more partitions than its number of texts, or the cores, ask for."""
    return few(docs, docs.count(), 2 * docs.sparkSession.sparkContext.defaultParallelism, FILE_TEXTS)


def _placed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a column that tells rows apart, the same at every reading: a row's file and its number in it.

    Rows that come from no file are written to the shared folder first.
    """
    name = _free(docs, "row_place")

    def added(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")
        return rows.withColumn(name, F.concat_ws("#", place["file_path"], place["row_index"]))

    try:
        out = added(docs)
        out.schema  # noqa: B018  (resolves the column)
        return out, name
    except AnalysisException:
        return added(Scratch(spark, "pipeline-rows").save(docs, "docs")), name


def _without(spark: SparkSession, docs: DataFrame, place: str, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose place is not in `gone`, a written list that is broadcast if it is short."""
    gone, hint = bounded(gone.select(F.col("place").alias(place)).distinct(), Scratch(spark, "pipeline-gone"), "gone")
    return docs.join(hint(gone), place, "left_anti").drop(place)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on all labels, does not call toxic; a text without words is judged like any other."""
    text_batches(spark)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, said = _free(docs, "toxic_score"), _free(docs, "toxic_predicted")
    return toxicity.classify(_whole_files(docs), net, out_cols=(score, said)).where(F.col(said) == 0).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (similarity 0.8 or more): of the least doc_id, and of repeats of that one.

    Rows without words or without a doc_id are in no group and stay.
    """
    text_batches(spark)
    rows, place = _placed(spark, docs)
    rows = _whole_files(rows)
    marks = Scratch(spark, "pipeline-marks").save(neardup.near_duplicates(rows, share=80, place=F.col(place)), "marks")
    heads = marks.where("kept and n_shingles > 0 and doc_id is not null")
    # A group's first row may come again: texts of one set under one id.
    many = heads.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = heads.join(many, "component_id").where("place <> first").select("place")
    return _without(spark, rows, place, marks.where("not kept").select("place").unionByName(again))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of `benchmark`."""
    text_batches(spark)
    rows, place = _placed(spark, docs)
    rows = _whole_files(rows)
    hits = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), place=F.col(place))
    return _without(spark, rows, place, hits.select("place"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind in brackets; n_chars follows the text."""
    text_batches(spark)
    spans, masked = _free(docs, "personal_spans"), _free(docs, "masked_text")
    rows = _whole_files(docs)
    found = pii.detect(rows, pii.train(rows), out_col=spans, redacted_col=masked)
    return found.withColumn("text", F.col(masked)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, with a digest of the bytes that the ids decode to."""
    text_batches(spark)
    both = bpe.encode(_whole_files(docs), RANKS, as_bytes=True, out_col="token_ids", keep=["doc_id", "lang", "source", "n_chars"], decoded_col="decoded")
    return both.select("doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(token_ids) div 4 as long)").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal-data", mask_personal_data),
    ("byte-bpe", tokenise),
]

#: No stage but the near-duplicate search and the decontamination can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder before the next."""
    work = Scratch(spark, "pipeline")
    docs = text_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, str(k))
        if 1 <= k < len(STAGES) - 1:
            work.drop(str(k - 1))
    return docs
