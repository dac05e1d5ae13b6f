"""Exact dedup as a stateful stream: digests in disk-backed keyed state, full bytes checked on hits.

``ingest`` runs a Structured Streaming query over a folder of documents. Its
state is keyed by the digest of the normalised text and never expires (no
watermark); RocksDB keeps it on disk and checkpoints it to the shared folder.
Per digest it retains the stable identifier that stays (the largest doc_id),
the content locator of that row (file and row number) and the number of rows.
A later call with the same state reads only files that are new and meets
everything seen before. Rows are aggregated per task before they reach the
state, so a text that a third of all rows hold is one row per task there.

``decide`` gives every row its fate. Rows whose digest was hit more than once
are compared byte by byte with the content at the locator; digests that turn
out to hold different texts are grouped anew by the whole text. DataFrame
functions only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlens.llm.common import scratch, with_columns_of, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: groups that hold more than one row in HOT of all are split; there are fewer than HOT of them
HOT = 2048
#: the filter in front of the byte check has 2**FILTER bits, in rows of 32,768
FILTER = 25
#: MB of memory that all state stores of one executor may take together
STATE_MB = 256

_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # each store would take some MB of disk beforehand
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normal(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _rows(documents: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``(id, file, at, digest)`` of every row read from Parquet files, by file and row number."""
    return documents.select(F.col("doc_id").cast("long").alias("id"), F.col("_metadata.file_path").alias("file"),
                            F.col("_metadata.row_index").alias("at"), digest(normal(F.col("text"))).alias("digest"))


def _needed(spark: SparkSession, path: str) -> T.StructType:
    documents = spark.read.parquet(path)
    with_columns_of(documents, "doc_id", "text")
    return T.StructType([documents.schema["doc_id"], documents.schema["text"]])


def new_state(spark: SparkSession) -> str:
    """A folder for a state of its own, in the shared scratch folder."""
    return f"{scratch(spark)}/contactlens-llm/exact-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256,
           files_per_batch: int | None = None) -> str:
    """Take the files under ``path`` that ``state`` has not seen into the state; returns ``state``.

    ``path`` names a folder of Parquet files (or one file) with ``doc_id`` and
    ``text``. The query stops when all files are read. If it dies, the next call
    goes on from the last finished batch. The number of state partitions is
    ``spark.sql.shuffle.partitions`` of the first call.
    """
    reader = spark.readStream.schema(_needed(spark, path))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = F.struct("id", "file", "at")
    # as a pattern (its last character in brackets) the path may also name a single file
    path = path.rstrip("/")
    rows = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest)
    held = rows.groupBy("digest").agg(F.max(place).alias("keep"), F.count(F.lit(1)).alias("rows"))
    with _conf(spark, _STREAM_CONF):
        run = (held.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
               .option("checkpointLocation", state).start())
        run.awaitTermination()
    return state


def held(spark: SparkSession, state: str) -> DataFrame:
    """What the state holds: ``(digest, keep(id, file, at), rows)``, one row per digest."""
    raw = spark.read.format("statestore").load(state)
    digest, (keep, rows) = raw.schema["key"].dataType[0], raw.schema["value"].dataType[:2]
    return raw.select(F.col(f"key.`{digest.name}`").alias("digest"), F.col(f"value.`{keep.name}`").alias("keep"),
                      F.col(f"value.`{rows.name}`").alias("rows"))


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """The hashes of a column as a bit array of fixed size: at most 2**FILTER / 32,768 rows of 4 KB."""
    return (keys.select(F.pmod(F.xxhash64(key), F.lit(1 << FILTER)).alias("at"))
            .groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")))


def _maybe_in(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys``: all that are, and few others until the array fills."""
    place = F.expr("bitmap_bit_position(_at)")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("_at", F.pmod(F.xxhash64(key), F.lit(1 << FILTER)))
            .join(F.broadcast(_bits(keys, key).toDF("_bucket", "_bits")), F.expr("bitmap_bucket_number(_at)") == F.col("_bucket"))
            .where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("_at", "_bucket", "_bits"))


def _hot(groups: DataFrame) -> DataFrame:
    """``(digest, parts)`` of the groups with more than one row in HOT of all: fewer than HOT rows, for a broadcast."""
    limit = max(1, (groups.agg(F.sum("rows")).first()[0] or 0) // HOT)
    return F.broadcast(groups.where(F.col("rows") > limit).select("digest", F.ceil(F.col("rows") / limit).cast("int").alias("parts")))


def _with_groups(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``groups`` on ``digest``; rows of ``hot`` groups are dealt to several tasks.

    Such a group's one row on the right is repeated once per part.
    """
    left = (rows.join(hot, "digest", "left")
            .withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("file", "at"), F.col("parts")).cast("int")))
            .drop("parts"))
    right = (groups.join(hot, "digest", "left")
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
    return left.join(right, ["digest", "part"]).drop("part")


def _texts(places: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``(id, file, at, digest, body)`` with the whole normalised text."""
    return places.select(F.col("doc_id").cast("long").alias("id"), "file", "at", normal(F.col("text")).alias("body")).withColumn(
        "digest", digest(F.col("body")))


def _regrouped(texts: DataFrame) -> DataFrame:
    """The rows of digests that hold several texts, grouped by the whole text."""
    groups = texts.groupBy("digest", "body").agg(F.max(F.struct("id", "file", "at")).alias("keep"), F.count(F.lit(1)).alias("rows"))
    return (texts.join(groups, ["digest", "body"])
            .select("id", "file", "at", "digest", "keep", "rows"))


def decide(documents: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row of ``documents`` with its group: ``(id, file, at, digest, keep, rows)``.

    ``documents`` is read from the Parquet files that the state has seen;
    ``groups`` is what the state holds.
    """
    groups = written(groups, "exact-held")
    hot = _hot(groups)
    placed = written(_with_groups(_rows(documents, digest), groups, hot), "exact-placed")
    # hits: the whole text of every row against the one at the locator
    spot = F.xxhash64("file", "at").alias("spot")
    places = documents.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "doc_id", "text")
    places = places.select("*", spot)
    texts = _texts(_maybe_in(places, placed.where("rows > 1").select(spot), "spot"), digest)
    kept = (groups.where("rows > 1").select("digest", F.col("keep.file").alias("file"), F.col("keep.at").alias("at"))
            .select("*", spot))
    held_text = (_texts(_maybe_in(places, kept, "spot"), digest).join(kept.drop("spot"), ["digest", "file", "at"], "left_semi")
                 .select("digest", F.col("body").alias("held")))
    unequal = _with_groups(texts, held_text, hot).where(F.col("body") != F.col("held")).select("digest").distinct()
    unequal = written(unequal, "exact-unequal")
    if unequal.isEmpty():
        return placed
    again = _regrouped(texts.join(unequal, "digest", "left_semi"))
    return placed.join(unequal, "digest", "left_anti").unionByName(again.select(placed.columns))


def dedup(spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256,
          files_per_batch: int | None = None) -> DataFrame:
    """All columns of the documents under ``path``, every row, with what became of it.

    Added: ``_keep_id`` (doc_id of the row that stays for this text),
    ``_group_size`` (rows with this text), ``_kept`` (whether it is this row)
    and ``_digest`` (of the normalised text); input columns of these names give
    way to them. Texts are equal when identical after lower-casing A-Z; a null
    text is an empty one. Of equal texts the row with the largest doc_id stays;
    a null doc_id is smaller than any other (``_keep_id`` is null if all are).
    Of repeated rows of one doc_id the one in the last file (by name) and there
    the last row stays, so exactly one row of each text is kept. An empty table
    gives an empty result.
    """
    state = ingest(spark, path, state or new_state(spark), digest, files_per_batch)
    documents = spark.read.parquet(path)
    own = [c for c in documents.columns if c not in ("_keep_id", "_group_size", "_kept", "_digest")]
    place = documents.metadataColumn("_metadata")  # a column of this name does not hide it
    wide = documents.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(own)],
                            place["file_path"].alias("file"), place["row_index"].alias("at"))
    found = _fate(_decided(spark, path, state, digest)).drop("id")
    return (wide.join(found, ["file", "at"])
            .select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(own)], "_keep_id", "_group_size", "_kept", "_digest"))


def _decided(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column]) -> DataFrame:
    documents = spark.read.schema(_needed(spark, path)).parquet(path)
    if documents.isEmpty():
        place = "struct<id:long,file:string,at:long>"
        return spark.createDataFrame([], f"id long, file string, at long, digest string, keep {place}, rows long")
    return decide(documents, held(spark, state), digest)


def _fate(rows: DataFrame) -> DataFrame:
    kept = (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))
    return rows.select("id", "file", "at", F.col("keep.id").alias("_keep_id"), F.col("rows").alias("_group_size"),
                       kept.alias("_kept"), F.col("digest").alias("_digest"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    state = ingest(spark, path, new_state(spark))
    out = _fate(_decided(spark, path, state, sha256))
    return out.select(F.col("id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
                      F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
