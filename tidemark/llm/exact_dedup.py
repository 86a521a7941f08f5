"""Exact de-duplication as a stateful stream.

The documents are read as a stream. Its state is keyed by the digest of the
normalised text, kept on disk (RocksDB provider) and never expires: for each digest
the stable identifier (smallest id so far), the content locator (file and id of that
row) and the number of rows. Micro-batches only aggregate digests, so that a group of
any size is one row of state, added up before the shuffle.

Digests that were hit more than once are checked on the full bytes: within a digest
the smallest and the largest text must be the same string. Should they differ, the
rows of that digest are grouped by the text itself.

Null counts as the empty text. Rows that repeat an id count as rows of their own: if the
smallest id of a group is repeated, all its rows with a text of the group are ``kept``. A
null id is larger than any other, so that such a row stays only where its group has no
id. An empty table gives an empty result. Only id and text are read, so that other
columns can have any name; texts of any length are compared whole.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import SPACE, delete, materialise, shared_dir

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: no disk is set aside in advance
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for the start of a query; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_state(stream: DataFrame, checkpoint: str, digest: Column) -> DataFrame:
    """Feed all that ``stream`` has into the keyed state and return it: digest, keep_id, locator, group_size.

    ``stream`` has the columns doc_id, text and locator. A second run with the same
    ``checkpoint`` reads only what is new and adds to the state.
    """
    spark = stream.sparkSession
    keyed = stream.select(digest.alias("digest"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator").alias("row"))
    state = keyed.groupBy("digest").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("group_size"))
    out = f"{checkpoint}/changes"

    def save(changes: DataFrame, batch: int) -> None:
        changes.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = "digest string, kept struct<none: boolean, doc_id: bigint, locator: string>, group_size long, batch long"
    if query.lastProgress is None and not spark.read.format("binaryFile").load(f"{checkpoint}/state/offsets").take(1):
        changes = spark.createDataFrame([], schema)
    else:
        changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    # The last version of a digest is its state.
    latest = changes.groupBy("digest").agg(F.max_by(F.struct("kept", "group_size"), "batch").alias("s"))
    return latest.select("digest", F.col("s.kept.doc_id").alias("keep_id"), F.col("s.kept.locator").alias("locator"), F.col("s.group_size").alias("group_size"))


def exact_duplicates(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, checkpoint: str | None = None) -> DataFrame:
    """One row per document of the Parquet table at ``path``: what it equals and whether it stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256 and the locator of the kept
    row. ``digest_bits`` shortens the state's key (tests use it to force collisions). With
    a ``checkpoint`` the state stays there and a later run goes on from it; without one it
    is deleted.
    """
    table = spark.read.parquet(path)
    folder = checkpoint or shared_dir(spark)
    key = F.substring(F.sha2(normalised(F.col("text")), 256), 1, digest_bits // 4)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    # As a pattern, because a stream's plain path must be a folder and a table may be a single file.
    stream = spark.readStream.schema(table.schema).parquet(f"{path[:-1]}[{path[-1]}]").select(*columns, F.col("_metadata.file_path").alias("locator"))
    state = materialise(run_state(stream, folder, key))
    if checkpoint is None:  # nobody will go on from this state
        delete(spark, folder)

    docs = table.select(*columns)
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    rows = rows.withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4))
    several = state.where("group_size > 1").select("digest")
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", F.substring(F.sha2("text", 256), 1, digest_bits // 4))
    hits = texts.join(several, "digest", "left_semi")
    unequal = hits.groupBy("digest").agg((F.min("text") < F.max("text")).alias("unequal")).where("unequal").select("digest")
    if unequal.isEmpty():
        group = state
        out = rows.join(group, "digest")
    else:
        # different texts under one digest: the text itself is the key there
        exact = texts.join(unequal, "digest", "left_semi").groupBy(F.sha2("text", 256).alias("text_sha256"), "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        mine = texts.join(unequal, "digest", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        apart = mine.join(exact, ["text_sha256", "text"]).select("doc_id", "text_sha256", "keep_id", F.lit(None).cast("string").alias("locator"), "group_size")
        alike = rows.join(unequal, "digest", "left_anti").join(state, "digest").select(*apart.columns)
        out = alike.unionByName(apart)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "locator")
