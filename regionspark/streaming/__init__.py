"""Worker events as a stream, and the folds of edit logs that batch and stream share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("protocol_version", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("request_id", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)


def worker_events(spark: SparkSession, folder: str, streaming: bool = True) -> DataFrame:
    """JSON lines of a folder as rows of MESSAGE; blank lines drop out, a line that does not parse is a row of status
    ``bad_line`` with the line as its payload."""
    reader = spark.readStream if streaming else spark.read
    lines = reader.format("text").load(folder)
    parsed = lines.select(F.btrim("value", F.lit(" \t\r")).alias("line")).filter("line <> ''").select("line", F.from_json("line", MESSAGE).alias("m"))
    bad = F.col("m.seq").isNull() & F.col("m.status").isNull() & F.col("m.event").isNull() & F.col("m.request_id").isNull()
    told = {"status": F.lit("bad_line"), "payload": F.col("line")}
    columns = [F.when(bad, told[f.name]).otherwise(F.col(f"m.{f.name}")).alias(f.name) if f.name in told else F.col(f"m.{f.name}").alias(f.name) for f in MESSAGE]
    return parsed.select(*columns)


def accepted(events: DataFrame, jobs: list[str], version: int) -> DataFrame:
    """Events of the given jobs and protocol version; late and foreign ones drop out."""
    return events.filter((F.col("protocol_version") == version) & F.col("job_id").isin(jobs))


def is_error(events: DataFrame) -> DataFrame:
    """Flags messages whose status or event is an error."""
    return events.withColumn("is_error", (F.coalesce("status", F.lit("")) == "error") | (F.coalesce("event", F.lit("")) == "error"))


def job_counts(events: DataFrame) -> DataFrame:
    """Events of each job by kind; the state is one row for a job and kind."""
    return events.groupBy("job_id", "event").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


def folded_decisions(log: DataFrame, key: list[str], most: int = 100) -> DataFrame:
    """The state after an edit log (seq, op, decision): a step sets a decision, an undo takes back the latest step of the
    item that is not taken back yet, and setting what holds already is no step. At most ``most`` steps can be undone.

    A higher-order fold over an item's own steps in order; an item's log is short."""
    steps = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "decision"))).alias("steps"))
    empty = F.array(F.lit("unreviewed"))

    def step(stack, s):
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("unreviewed"))
        undone = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1)))
        pushed = F.concat(stack, F.array(s["decision"]))
        kept = F.when(F.size(pushed) > most + 1, F.slice(pushed, 2, most + 1)).otherwise(pushed)
        return F.when(s["op"] == "undo", undone).when(s["decision"] == top, stack).otherwise(kept)

    stack = F.aggregate("steps", empty, step)
    return steps.select(*key, F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("unreviewed")).alias("decision"), (F.size(stack) - 1).cast("long").alias("depth"))
