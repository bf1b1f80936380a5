"""Cache entries, requests and logs derived from the given parquet tables, always whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echocache.functions import vectors as V

# Fixed values of the derived inputs; the check SQL uses the same ones.
START = 1_700_000_000
LATER = 1_800_000_000
WEIGHTS = (0.1, 0.5, 0.7, 1.2)
TURN_BITS = 24
BEFORE = 1 << 60


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files: a folder of part files, or the one file of that name."""
    place = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return reader.parquet(place)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _collection(by_label: bool):
    return F.concat(F.lit("c"), "label") if by_label else F.lit("all")


def vector_entries(spark: SparkSession, folder: str, by_label: bool = True) -> DataFrame:
    """Every row of ``embeddings`` as a cached entry."""
    created = F.lit(START) + F.col("vec_id")
    vector = V.as_vector("embedding")
    return table(spark, folder, "embeddings").select(
        _collection(by_label).alias("collection"),
        F.concat(F.lit("entry-"), F.col("vec_id") + 1).alias("id"),
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("prompt "), "vec_id").alias("prompt"),
        F.concat(F.lit("response "), "vec_id").alias("response"),
        vector.alias("vector"),
        V.norm(vector).alias("norm"),
        F.timestamp_seconds(created).alias("created_at"),
        F.timestamp_seconds(created + F.col("vec_id") * 7919 % 1000).alias("last_accessed_at"),
    )


def vector_requests(spark: SparkSession, folder: str, by_label: bool = True) -> DataFrame:
    """Every row of ``embeddings`` as a request: its vector plus a share of its own reverse."""
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("vec_id") % len(WEIGHTS) + 1).cast("int")
    )
    plain = table(spark, folder, "embeddings").select(
        "vec_id", "label", V.as_vector("embedding").alias("v"), weight.alias("w")
    )
    return plain.select(
        _collection(by_label).alias("collection"),
        F.concat(F.lit("r"), "vec_id").alias("request_id"),
        F.col("vec_id").alias("seq"),
        F.timestamp_seconds(F.lit(LATER) + F.col("vec_id")).alias("ts"),
        F.concat(F.lit("prompt "), "vec_id").alias("prompt"),
        F.zip_with("v", F.reverse("v"), lambda x, y: x + y * F.col("w")).alias("vector"),
    )


def dialogue(spark: SparkSession, folder: str) -> DataFrame:
    """Every user turn of ``conversations`` as a request whose prompt is the turn before and the
    turn itself; ``response`` is the assistant turn after it, if there is one."""
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    previous = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous")
    )
    reply = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    joined = asked.join(previous, ["conv_id", "turn"], "left").join(
        reply, ["conv_id", "turn"], "left"
    )
    seq = F.shiftleft("conv_id", TURN_BITS) + F.col("turn")
    return joined.select(
        F.lit("chat").alias("collection"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        seq.alias("seq"),
        F.timestamp_seconds(F.lit(LATER) + F.col("conv_id")).alias("ts"),
        F.concat_ws(" ", "previous", "text").alias("prompt"),
        "response",
    )


def marred_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn of ``conversations`` as a prompt and response, some blank, padded or missing."""
    kind = F.col("conv_id") % 10
    prompt = (
        F.when(kind == 0, F.lit(" \t\n"))
        .when(kind == 1, F.concat(F.lit("\t  "), "text", F.lit("  \n")))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select(
        F.col("role").alias("collection"),
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        prompt.alias("prompt"),
        F.when(kind == 2, F.lit(None)).when(kind == 3, F.lit("\n")).otherwise(F.col("text"))
        .alias("response"),
    )


def marred_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``vector_requests``, some vectors empty, zero, not finite or cut short."""
    kind = F.col("seq") % 50
    nothing = F.array().cast("array<double>")
    vector = (
        F.when(kind == 0, nothing)
        .when(kind == 1, F.transform("vector", lambda x: F.lit(0.0)))
        .when(kind == 2, F.slice("vector", 1, 32))
        .when(kind == 3, F.concat("vector", F.array(F.lit(float("nan")))))
        .otherwise(F.col("vector"))
    )
    return vector_requests(spark, folder).withColumn("vector", vector)


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``events`` as a request for the key in its properties."""
    return log_columns(table(spark, folder, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("collection"),
        F.concat(F.lit("e"), "event_id").alias("request_id"),
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("key"),
    )


def one_hot(log: DataFrame, size: int = 100) -> DataFrame:
    """The log with a vector that is 1 at its key and 0 elsewhere."""
    at = F.col("key").cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return log.withColumn("vector", F.concat(zeros(at), F.array(F.lit(1.0)), zeros(size - 1 - at)))


def log_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``events`` as an entry without texts, accessed some time after creation."""
    created = F.lit(START) + F.col("event_id")
    access = created + F.floor(F.col("value") * 100).cast("long")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("collection"),
        F.concat(F.lit("entry-"), F.col("event_id") + 1).alias("id"),
        F.col("event_id").alias("seq"),
        F.timestamp_seconds(created).alias("created_at"),
        F.timestamp_seconds(access).alias("last_accessed_at"),
    )


def log_inserts(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of ``events`` once more, as a later insert."""
    now = F.timestamp_seconds(F.lit(LATER) + F.col("event_id"))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("collection"),
        F.concat(F.lit("new-"), "event_id").alias("id"),
        (F.col("event_id") + LATER).alias("seq"),
        now.alias("created_at"),
        now.alias("last_accessed_at"),
    )
