"""Exact deduplication by a stateful stream, DataFrame functions only.

The documents are written once with a row number and the digest of their normalised
text. A stream over that table keeps, in disk-backed state without expiry, for each
digest the identifier and the locator (arrival and row number in the table) of the row
that stays, and how many rows it has seen. Groups are summed on the map side before the
shuffle. Where a digest has been hit again the full normalised texts are compared; texts
that only share the digest are told apart. The state lasts: documents that arrive later
are streamed into the same store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.workspace import new_path, stored

#: Fixed values.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one digest that are compared together.
PART = 256
#: State on disk; without preallocated files, of which each partition of the state would have some.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """A to Z in lower case, null as the empty text; nothing else changes."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _add(docs: DataFrame, store: str, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Writes docs to the table that the stream reads, as one more arrival; that table."""
    spark = docs.sparkSession
    path = f"{store}/rows"
    arrival = 0
    if _exists(spark, path):
        arrival = (spark.read.parquet(path).agg(F.max("_arrival")).first()[0] or 0) + 1
    rows = docs.select(
        F.lit(arrival).alias("_arrival"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(f"`{id_col}`").alias("_id"),
        digest(normalised(F.col(f"`{text_col}`"))).alias("_digest"),
        F.struct("*").alias("_doc"),
    )
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def seen(rows: DataFrame, store: str, files_a_batch: int = 10_000) -> DataFrame:
    """The state after all rows of the store have streamed by: _digest, keep (struct of _id, _arrival, _row), n.

    Rows that an earlier call has streamed are not read again: their state is in the store.
    """
    spark = rows.sparkSession
    light = rows.select("_digest", "_id", "_arrival", "_row")
    counted = [F.max(F.struct("_id", "_arrival", "_row")).alias("keep"), F.count(F.lit(1)).alias("n")]
    if not rows.inputFiles():
        return light.groupBy("_digest").agg(*counted)
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(light.schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{store}/rows")
        state = stream.groupBy("_digest").agg(*counted)
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{store}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.format("statestore").load(f"{store}/state")
        names = found.schema["value"].dataType.names
        return stored(found.select(F.col("key._digest").alias("_digest"), F.col(f"value.`{names[0]}`").alias("keep"), F.col(f"value.`{names[1]}`").alias("n")), "exact-dedup-seen")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_a_batch: int = 10_000, store: str | None = None) -> DataFrame:
    """Every row with the row that stays of those with the same text: _arrival, _row, _id, _digest, _doc, keep_id, kept, group_size.

    Texts are the same if equal after lower-casing A to Z; a null text is empty, so all
    null and empty texts are one group. The row with the largest id stays; null ids are
    the smallest, and of rows that repeat an id the one that arrived last stays, then the
    one with the larger row number. Columns of docs are inside _doc, so none can clash. An
    empty table gives no rows.

    store: a folder that all executors share, which keeps the rows and the stream's state.
    With the same store, a later call adds its docs to those of earlier calls (of the same
    columns) and streams only these; the result then has the rows of all arrivals. Without
    one, a new store is made.
    """
    store = store or new_path(docs.sparkSession, "exact-dedup")
    rows = _add(docs, store, id_col, text_col, digest)
    state = seen(rows, store, files_a_batch)
    text = normalised(F.col("_doc")[text_col])
    # A group is compared in parts of PART rows, so that a text with very many copies is no large task;
    # what the parts are is decided before the shuffle, and of each part one row for each text goes on.
    hit = state.where("n > 1").select("_digest", F.ceil(F.col("n") / PART).alias("_parts"))
    parts = rows.select("_digest", "_id", "_arrival", "_row", text.alias("_text")).join(hit, "_digest")
    parts = parts.withColumn("_part", F.pmod(F.xxhash64("_arrival", "_row"), F.col("_parts"))).repartition("_digest", "_part")
    parts = parts.groupBy("_digest", "_part", "_text").agg(F.max(F.struct("_id", "_arrival", "_row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    exact = parts.groupBy("_digest", "_text").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"))
    several = stored(exact.groupBy("_digest").count().where("count > 1").select("_digest"), "exact-dedup-several")
    out = rows.join(state, "_digest")
    if several.limit(1).count():  # texts that share a digest
        some = rows.join(several, "_digest", "left_semi").withColumn("_text", text)
        own = exact.join(several, "_digest", "left_semi")
        out = out.join(several, "_digest", "left_anti").unionByName(some.join(own, ["_digest", "_text"]).drop("_text"))
    kept = (F.col("keep._row") == F.col("_row")) & (F.col("keep._arrival") == F.col("_arrival"))
    return out.select("_arrival", "_row", "_id", "_digest", "_doc", F.col("keep._id").alias("keep_id"), kept.alias("kept"), F.col("n").alias("group_size"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return groups(docs, id_col, text_col).where("kept").select("_doc.*")
