"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorium.llm.base import Scratch, pick


def unit_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) from key and shard: the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / 4503599627370496.0


def choose(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the largest ``-weight / ln(hash(key, shard))``.

    A record's rank of the shards never depends on other shards, so a new shard only
    takes records into itself and a removed one only gives its own away. Equal weights
    give equal expected counts; equal numbers go to the smaller shard.
    """
    # the smallest -ln(u) / weight, with the shard as tie break
    costs = [F.struct((-F.log(unit_hash(key, s)) / F.lit(float(w))).alias("cost"), F.lit(int(s)).alias("shard")) for s, w in sorted(weights.items()) if w > 0]
    if not costs:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*costs))["shard"]


def shard(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put every row into a shard and number the rows of each shard.

    Result: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the
    text's UTF-8 bytes (null: none) plus 16; ``text_crc32`` is unsigned, 0 for null or
    empty texts. The id as text is the key, so repeated rows share a shard; a null id is
    the key of its own, the empty string. Slots run from 0 in order of the id.
    ``grown``: weights of a second layout, whose choice is ``grown_shard``.
    The text is dropped before the only shuffle, a range shuffle by (shard, id, row), in
    which no shard and no repeated id has to fit into one task.
    """
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, doc_id=id_column, text=text_column)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    placed = scratch.keep(
        rows.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            choose(key, weights).alias("shard"),
            (choose(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    order = ["shard", "doc_id", "row"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    numbered = scratch.keep(
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id())
        .drop("row")
    )
    # a shard lies in consecutive parts; (part, shard) pairs are at most parts + shards
    pieces = numbered.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    held = F.collect_list(F.struct("part", "rows", "first")).alias("held")
    before = F.transform(
        F.array_sort("held"),
        lambda x: F.struct(
            x["part"].alias("part"),
            (F.aggregate(F.filter("held", lambda y: y["part"] < x["part"]), F.lit(0).cast("long"), lambda n, y: n + y["rows"]) - x["first"]).alias("shift"),
        ),
    )
    shifts = pieces.groupBy("shard").agg(held).select("shard", F.explode(before).alias("b")).select("shard", "b.part", "b.shift")
    return numbered.join(F.broadcast(scratch.keep(shifts)), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"
    )
