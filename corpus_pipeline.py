"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; a document's text may be shorter, and the mix may repeat it.

Defined results, of every stage: a null text counts as an empty one and stays null where
the row stays; null and repeated ids are allowed, as rows are told apart by all their
columns; texts are taken whole, however long; an empty table gives an empty table; extra
columns are carried (packing, which makes pieces, leaves them out). What ties give is
said at each stage.

Texts can be long, so the stages lower the session's ``maxRecordsPerBatch`` to ``ROWS_AT_ONCE``
if it is more: so many texts at a time go to Python, which bounds what its workers hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import linededup, mixing, neardup, packing, toxicity
from vigil.llm.queries import _vocabulary
from vigil.llm.store import scope, written


ROWS_AT_ONCE = 500
PACKED_AT_ONCE = 1 << 18  # ids whose cuts are chosen together


def _few_at_once(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; one at the threshold goes. Without labels of class 1 all stay."""
    _few_at_once(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels), name="__c_score")
    return scored.where(F.col("__c_score") < toxicity.THRESHOLD).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated passages that an earlier place has.

    Places are ordered by id (null first), text and line; rows with equal id and text are
    one document, so none of them loses lines to another. A null text stays null.
    """
    return linededup.dedup_passages(docs).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of five-word similarity 0.8 or more, with the smallest id of it.

    Of rows with that id the one with the smallest hash of id and text stays, of those
    equal in both the one with the smallest hash of all columns. Null and empty texts are
    one class. Only keys are shuffled; texts meet the few rows that go, or go to be compared.
    """
    _few_at_once(spark)
    columns = [F.col(c) for c in docs.columns]
    found = neardup.near_duplicates(docs)
    own = F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("key_a", "key_b"))
    with scope():
        several = written(found.groupBy("class_id").agg(F.count("*").alias("n"), F.min(own).alias("stays")).where("n > 1"), "several")
        members = found.join(several, "class_id").groupBy("key_a", "key_b").agg(F.count("*").alias("n"), F.max(F.struct("key_a", "key_b") == F.col("stays")).alias("stays"))
        marks = written(members.where("n > 1 or not stays").select(F.col("key_a").alias("__c_a"), F.col("key_b").alias("__c_b"), F.col("stays").alias("__c_twice")), "marks", keep=True)
    keyed = docs.withColumns({"__c_a": F.xxhash64("doc_id", "text"), "__c_b": F.xxhash64("doc_id", "text", F.lit(1))}).join(marks, ["__c_a", "__c_b"], "left")
    kept = keyed.where("__c_twice is null").select(*columns)
    if not marks.where("__c_twice").limit(1).count():
        return kept
    one = keyed.where("__c_twice").groupBy("__c_a", "__c_b").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__c_row"))
    return kept.unionByName(one.select("__c_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Of rows equal in all columns as many stay as are taken in all."""
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumns({"__c_a": F.xxhash64(*columns), "__c_b": F.xxhash64(*columns, F.lit(1))})
    found = mixing.items(keyed, keep=("__c_a", "__c_b")).select("doc.*", "rows", (F.col("rows") * F.col("whole") + F.col("more")).alias("__c_copies"))
    taken = written(found.where("__c_copies > 0"), "taken", keep=True)
    single = keyed.join(taken.where("rows = 1").drop("rows"), ["__c_a", "__c_b"]).withColumn("__c_copy", F.explode(F.sequence(F.lit(1).cast("long"), "__c_copies"))).select(*columns)
    equal = taken.where("rows > 1").drop("rows")
    if not equal.limit(1).count():
        return single
    one = keyed.join(equal, ["__c_a", "__c_b"]).groupBy("__c_a", "__c_b", "__c_copies").agg(F.first(F.struct(*columns)).alias("__c_row"))
    return single.unionByName(mixing.repeated(one, "__c_copies", "__c_a", "__c_b").select("__c_row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids; a null or empty text is its end mark alone."""
    _few_at_once(spark)
    return packing.pack(docs, _vocabulary("byte_bpe_50k.json"), block=PACKED_AT_ONCE)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, learning and tokenizing stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents, each result written and read again; a stage's own tables go when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scope():
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
