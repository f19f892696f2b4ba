"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm import jaccard, mixing, packing, pii, toxicity
from bytewright.plans.columns import pick
from bytewright.plans.scratch import materialize
from bytewright.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of up to ``BATCH_ROWS``, for the memory that a batch takes on both sides; the
    setting stays, as a stage's rows are made after it has returned. A lower one of the session's own is kept."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the model is fitted on the labelled documents not held out.

    Null and empty texts score as the least toxic word and stay; rows without doc_id are scored like others; repeated rows are judged
    alike; without both labels all stay; texts are scored whole; an empty table stays one; other columns are dropped."""
    _small_batches(spark)
    docs = pick(docs, *COLUMNS)
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row: that with the smallest doc_id (rows without one come last), then with the least
    hash of the text, then columns.

    Null and empty texts and those without words are no duplicates and all stay; rows that share a doc_id but no component are
    documents of their own; of rows equal in doc_id and text one stays; an empty table stays one; other columns are dropped."""
    _small_batches(spark)
    docs = pick(docs, *COLUMNS)
    found = materialize(jaccard.classes(docs.select("doc_id", "text")).where("component is not null").select("doc_id", "h", "component"), "pipeline-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    first = materialize(found.groupBy("component").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pipeline-first")
    rows = found.join(first, "component")
    gone = materialize(rows.where("not (doc_id <=> first.doc_id and h = first.h)").select("doc_id", "h").distinct(), "pipeline-gone")
    twice = materialize(rows.where("doc_id <=> first.doc_id and h = first.h").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "pipeline-twice")
    few = lambda df: F.broadcast(df) if df.count() <= jaccard.BROADCAST_ROWS else df
    docs = docs.withColumn("_h", F.xxhash64("text"))
    same = lambda df: docs["doc_id"].eqNullSafe(df["doc_id"]) & (docs["_h"] == df["h"])
    kept = docs.join(few(gone), same(gone), "left_anti")
    if not twice.take(1):
        return kept.select(*COLUMNS)
    many = few(twice)
    once = kept.join(many, same(twice), "left_semi").groupBy("doc_id", "_h").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.join(many, same(twice), "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars counted anew where there were any.

    Null and empty texts and those without entities stay as they are, n_chars too; doc_id plays no part; repeated rows are treated
    alike; texts are read whole; an empty table stays one; other columns are dropped."""
    out = pii.redact(pick(docs, *COLUMNS), spark.conf.get(pii.KEY_SETTING, pii.KEY))
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes.

    Null and empty texts have no words and are taken as often as their place in the order says; rows without doc_id share a hash, but are taken by their own text and source; rows equal in
    doc_id, source and text are taken as often as the one taken most; null is a source like any other; an empty table stays one;
    other columns are dropped."""
    docs = pick(docs, *COLUMNS).withColumn("_h", F.xxhash64("text"))
    small = materialize(mixing.sized(docs, "_h").drop("text"), "pipeline-sizes")
    taken = mixing.mix(small).where("copies > 0").groupBy("doc_id", "source", "_h").agg(F.max("copies").cast("int").alias("copies"))
    taken = materialize(taken, "pipeline-copies").toDF("_id", "_source", "_key", "copies")
    few = F.broadcast(taken) if taken.count() <= jaccard.BROADCAST_ROWS else taken
    out = docs.join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_key")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    A null or empty text is the end's id alone; rows without doc_id keep none; repeated rows are packed as often; documents longer than
    a sequence are cut; an empty table gives no piece; other columns are ignored."""
    _small_batches(spark)
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models, hashes of shingles and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
