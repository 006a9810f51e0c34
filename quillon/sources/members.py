"""Members of one huge JSON object, {key: object, ...}, read in byte ranges (EXT7).

Small files are parsed as they are. The text of others is split at every closing brace, which Spark's text scan does wherever a byte range begins. What a split needs
to know of the text before it is whether it starts inside a string and how deep: both are sums, taken for each split first
and then inside it. A member ends where a brace leads back to depth 1; its pieces are few and are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import discard, materialize

_SPLIT = ["file", "block"]


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows of the file before each row: a row a split is summed over the file, the rest inside the split."""
    sizes = df.groupBy(*_SPLIT).agg(F.sum(value).alias("_v"))
    before = sizes.select(*_SPLIT, F.coalesce(F.sum("_v").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(before, _SPLIT).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _braces(bare: Column) -> Column:
    return F.regexp_count(bare, F.lit(r"[\{\[]")) - F.regexp_count(bare, F.lit(r"\]"))


#: Bytes of a file up to which one task takes it whole.
WHOLE_BYTES = 16 << 20


def read_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, key, value (VARIANT) of the top-level members of each file; of repeated keys the last.

    The results are those of a parser of the whole file, whatever the size of the splits; no task holds more than a
    split's pieces (spark.sql.files.maxPartitionBytes), or one member, or one small file. A file has to hold one JSON object; an empty one has no member.
    Small files that Spark's parser takes are parsed as they are read, without a shuffle; larger ones, compressed ones and those that it refuses (repeated keys) go through their pieces.
    """
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    plain = ~F.regexp_like(name, F.lit(r"(?i)\.(gz|bz2|zst|zstd|lz4|snappy|deflate)\z"))
    small = plain & (size <= min(WHOLE_BYTES, _split_bytes(spark)))
    texts = spark.read.option("wholetext", True).text(path).where(small).select(name.alias("file"), F.col("value").alias("text"))
    fine = F.regexp_like("text", F.lit(r"\A\s*\{")) & F.try_parse_json("text").isNotNull()
    whole = texts.where(fine).select("file", F.explode(F.from_json("text", "map<string,variant>")).alias("key", "value"))
    refused = materialize(texts.where(~F.coalesce(fine, F.lit(False))).select("file"))
    pieces = spark.read.option("lineSep", "}").text(path).select(
        name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"), small.alias("_small"),
    )
    larger = pieces.where(~F.coalesce(small, F.lit(False))).drop("_small")
    if refused.isEmpty():
        discard(refused)
        return whole if larger.isEmpty() else whole.unionByName(_from_pieces(spark, larger))
    return whole.unionByName(_from_pieces(spark, larger.unionByName(pieces.where("_small").drop("_small").join(refused, "file", "left_semi"))))


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _from_pieces(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """file, key, value of files as rows (file, block, at, piece) that were split at closing braces."""
    # an escape never spans a brace, and braces, brackets and quotes inside of escapes don't count
    pieces = materialize(pieces.withColumn("bare", F.regexp_replace("piece", r"\\.", "")).withColumn("quotes", F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit("")))))
    known = _running(pieces, "quotes", "_quotes").withColumn("inside", F.col("_quotes") % 2 == 1)
    opened = F.when(F.col("inside"), F.concat(F.lit('"'), "bare")).otherwise(F.col("bare"))
    outside = F.regexp_replace(F.regexp_replace(opened, r'"[^"]*"', ""), r'"[^"]*\z', "")
    ends_inside = (F.col("_quotes") + F.col("quotes")) % 2 == 1
    # the brace that follows a piece closes something unless it is inside a string
    depths = known.select("file", "block", "at", "piece", (_braces(outside) - F.when(ends_inside, 0).otherwise(1)).alias("step"), ends_inside.alias("in_string"))
    deep = _running(depths, "step", "_depth").withColumn("after", F.col("_depth") + F.col("step"))
    deep = materialize(deep.withColumn("end", F.when((F.col("after") <= 1) & ~F.col("in_string"), 1).otherwise(0)).select("file", "block", "at", "piece", "end"))
    numbered = _running(deep, "end", "member")
    whole = numbered.groupBy("file", "member").agg(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["piece"]), "}")
    # a member's text begins after the object's opening brace or a comma; its own closing brace was the separator
    body = F.regexp_replace(text, r"\A\s*[\{,]?", "")
    closed = F.when(F.regexp_like(body, F.lit(r"\A\s*\z")), F.lit("{}")).otherwise(F.concat(F.lit("{"), body, F.lit("}}")))
    last = F.concat(F.lit("{"), body, F.lit("}"))  # members behind the last object's end have no brace of their own
    parsed = whole.select("file", "member", F.coalesce(F.try_parse_json(closed), F.try_parse_json(last), F.parse_json(F.lit("{}"))).alias("v"))
    members = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", "member", "pos", "key", "value")
    return members.groupBy("file", "key").agg(F.max_by("value", F.struct("member", "pos")).alias("value"))


ENTITIES = "map<string,struct<tokens:string,label:string,relations:array<array<string>>>>"


def read_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """report_id, text, entities of report graphs as they are published: {report: {text, entities: {id: {tokens, label, relations}}}}."""
    m = read_members(spark, path)
    return m.select(F.col("key").alias("report_id"), F.try_variant_get("value", "$.text", "string").alias("text"), F.try_variant_get("value", "$.entities", ENTITIES).alias("entities"))
