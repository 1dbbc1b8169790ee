"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of docs, further ones that a table may have among them; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm import decontam, langid, neardup, packing, pii
from engramite.llm.common import bound_batches, discard, fold, read_table, shared_dir


def _rows(docs: DataFrame, make) -> DataFrame:
    """make()(batch) -> batch of the same columns."""
    bound_batches(docs.sparkSession)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return docs.mapInArrow(run, docs.schema)


def _with_text(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts; where a text changed, its length follows."""
    old = batch.column("text").to_pylist()
    lengths = [n if a == b else len(b) for a, b, n in zip(old, texts, batch.column("n_chars").to_pylist(), strict=True)]
    for name, values in (("text", texts), ("n_chars", lengths)):
        k = batch.schema.get_field_index(name)
        batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
    return batch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without letters, null and empty ones among them, and those of which no language reaches
    the calibrated threshold. Rows are judged one by one, whatever repeats; without labelled rows none has a language, and all go."""
    model = spark.sparkContext.broadcast(langid.train(docs, ~(fold(docs, 3) == 1)))

    def make():
        m = model.value
        return lambda batch: batch.filter(pa.array([not m.predict(t)[2] for t in batch.column("text").to_pylist()], pa.bool_()))

    return _rows(docs, make)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays.

    Documents without an id, and those without words, stay. Rows that repeat an id are one document: of those that repeat its text too, one stays,
    the first by all its columns as JSON; different texts of one id stay beside each other."""
    found = neardup.near_duplicates(docs)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    key = docs["doc_id"].cast("bigint")
    stay = docs.join(kept.hint("shuffle_hash"), key == kept["__kept"], "left_semi")
    repeated = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice")
    if repeated.limit(1).count():
        several = stay.join(repeated, key == repeated["__twice"], "left_semi")
        row = F.struct(*[several[c] for c in docs.columns])
        first = several.groupBy(several["doc_id"].alias("__id"), several["text"].alias("__text")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
        stay = stay.join(repeated, key == repeated["__twice"], "left_anti").unionByName(first.select("__row.*"))
    return stay.unionByName(docs.where(key.isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; words of benchmark windows go from the others.

    A null or empty text has no words and stays; without items all stay; rows are judged one by one, whatever repeats."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, become the name of their kind. A null text stays null; rows are masked one by one, whatever repeats."""
    return _rows(docs, lambda: lambda batch: _with_text(batch, [None if t is None else pii.mask(t) for t in batch.column("text").to_pylist()]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is one piece, the closing id; rows that repeat are packed one by one; extra columns go."""
    return packing.pack(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", mask_personal_data), ("packing", pack)]

#: SQL can express neither the learned language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{name.replace(' ', '-').lower()}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        done, docs = docs, spark.read.parquet(path)
        if name != STAGES[0][0]:
            discard(done)  # the stage before's copy; documents themselves stay
    return docs
