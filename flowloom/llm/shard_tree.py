"""Sharding by a hierarchical weighted hash tree: regions, racks, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import Scratch

PER_RACK, RACKS_PER_REGION = 4, 5


def _draws(key: Column, weights: Sequence[float]) -> Column:
    """For each shard an exponential draw, -ln(u) / weight, with u from an MD5 of key and shard; weight 0 never wins."""
    each = F.array(*[F.lit(float(w)) for w in weights])

    def draw(shard: Column) -> Column:
        hashed = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, 12), 16, 10)
        u = (hashed.cast("double") + 0.5) / float(1 << 48)
        weight = F.get(each, shard)
        return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), draw)


def _descend(draws: Column, shards: int) -> tuple[Column, Column, Column]:
    """Region, rack and shard that the first `shards` draws lead to.

    A node's draw is the least of its children's, so it is exponential at the rate
    of their summed weight: at each level a child wins in proportion to its weight.
    When one shard's weight rises, rows move into it alone; when it falls, out of it
    alone; the other subtrees keep their rows and places.
    """
    racks = [(lo, min(lo + PER_RACK, shards)) for lo in range(0, shards, PER_RACK)]
    of_rack = [F.array_min(F.slice(draws, lo + 1, hi - lo)) for lo, hi in racks]
    regions = [range(lo, min(lo + RACKS_PER_REGION, len(racks))) for lo in range(0, len(racks), RACKS_PER_REGION)]
    least = lambda items: F.array_min(F.array(*[F.struct(draw.alias("draw"), F.lit(i).alias("at")) for i, draw in items]))["at"]
    region = least([(r, F.array_min(F.array(*[of_rack[k] for k in inside]))) for r, inside in enumerate(regions)])
    in_region = F.get(F.array(*[least([(k, of_rack[k]) for k in inside]) for inside in regions]), region)
    start = in_region * PER_RACK
    inside = F.slice(draws, start + 1, F.least(F.lit(PER_RACK), F.lit(shards) - start))
    shard = start + F.array_position(inside, F.array_min(inside)).cast("int") - 1
    return region, in_region, shard


def assign_shards(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Every row's shard: id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    The law is `key`: id and shard count alone decide the shard, and with one more
    shard (of weight 1) rows move only into that one; grown_shard is the place then.
    weights has one value a shard, 1 each if not given. size is the UTF-8 length of
    the text plus 16; a null text counts as empty (size 16, checksum 0). Rows with a
    null id share the key "null". slot numbers a shard's rows without gaps from 0 by
    id (nulls first), size and checksum; rows alike in all get slots in some order.
    Other columns are not used. An empty table gives an empty table.

    Only narrow rows are shuffled, once, by range; a key that many rows have is
    spread over partitions. A small table of row counts, one row for each shard in
    each partition, turns places within partitions into slots.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    weights = list(weights) if weights is not None else [1.0] * shards
    assert len(weights) == shards and max(weights, default=0) > 0, "one weight a shard, and one above 0 at least"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 16).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"),
        _draws(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), [*weights, 1.0]).alias("__draws"),
    )
    region, rack, shard = _descend(F.col("__draws"), shards)
    rows = rows.select("__id", "__size", "__crc", region.alias("__region"), rack.alias("__rack"), shard.alias("__shard"), _descend(F.col("__draws"), shards + 1)[2].alias("__grown"))
    rows = scratch.save(rows.withColumn("__n", F.monotonically_increasing_id()))
    order = ["__shard", "__id", "__size", "__crc", "__n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.save(dealt.withColumn("__n", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__n", 33)))
    held = dealt.groupBy("__part", "__shard").agg(F.count("*").alias("held"), F.min("__n").alias("first"))
    before = F.sum("held").over(Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("__part", "__shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"))
    scratch.drop(rows)
    # partitions + shards rows at most, whatever the input
    return dealt.join(F.broadcast(starts), ["__part", "__shard"]).select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("__shard").alias("shard"),
        (F.col("__n") + F.col("start")).alias("slot"), F.col("__grown").alias("grown_shard"), F.col("__region").alias("region"), F.col("__rack").alias("rack"),
    )
