"""Streams over response files as they arrive: scored rows, which need no state, and a running summary, which does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.prompts import META, with_metadata
from quillon.operators.scoring import GROUPINGS, metric_columns, parse_responses, score_responses, summary_dict
from quillon.schemas import RESPONSES
from quillon.sources.sinks import write_json


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every new JSONL file in `folder` is parsed, scored and appended to the Parquet table `out`, exactly once."""
    scored = score_responses(parse_responses(spark.readStream.schema(RESPONSES).json(folder)))
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_groups(responses: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """group_type, group and the metrics of a stream of responses (or a batch); each item counts once, with the response that came first.

    metadata: a static table that labels the items; without it responses bring their own labels. Responses without an id
    count once for each different row.
    """
    own = F.when(F.col("item_id").isNull(), F.xxhash64(*responses.columns))
    first = responses.withColumn("_own", own).dropDuplicates(["item_id", "_own"]).drop("_own")
    labelled = first if metadata is None else with_metadata(first.drop(*META), metadata)
    scored = score_responses(parse_responses(labelled))
    groups = [F.struct(F.lit(kind).alias("group_type"), (F.coalesce(c, F.lit("None")) if c is not None else F.lit("overall")).alias("group")) for kind, c in ((k, F.col(g) if g else None) for k, g in GROUPINGS.items())]
    return scored.withColumn("_g", F.explode(F.array(*groups))).select("*", "_g.*").groupBy("group_type", "group").agg(*metric_columns())


def summary_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, metadata: DataFrame | None = None, once: bool = True) -> StreamingQuery:
    """The score summary of all responses so far, replaced whole after every batch of new JSONL files.

    The state holds the ids seen and a row of counts for each group; a restart goes on from the checkpoint. A batch that
    is repeated after a failure writes the same summary again.
    """
    groups = running_groups(spark.readStream.schema(RESPONSES).json(folder), metadata)
    writer = groups.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: write_json(out, summary_dict(df)))  # a few dozen rows
    return (writer.trigger(availableNow=True) if once else writer).start()
