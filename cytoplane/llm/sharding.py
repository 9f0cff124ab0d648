"""Operator 13: sharding by fixed virtual slots, with DataFrame functions only.

A record's hash (of doc_id and text) puts it into one of thousands of virtual slots, for good. Which shard a slot is on
stands in a map of one row a slot, made from the bytes that each slot holds, and kept as numbered versions in a folder.
Rebalancing never deals records out anew: it edits the map, as a new version, and moves little more than what shards
have beyond their fair share.

1. `records` gives each row its size, checksum and slot, in one pass.
2. `slot_sizes` adds up bytes and rows by slot: sums of tasks, combined before they are shuffled.
3. `first_map` deals slots to shards, largest first, each to the shard with the fewest bytes so far. `rebalanced` does
   the same with the slots that a shard has beyond its fair share, or that were on shards that are gone, and leaves the
   others. Both fold over one array of the slots, whose number is a parameter and does not grow with the input.
4. `store_map` writes a version, `load_map` reads the last whole one or an older one.
5. `placed` joins records with the map (broadcast: a row a slot) and numbers each shard's rows from 0 without a gap: the
   slots of a shard follow one another, and within a slot the window's order counts. No task sees more than a slot.

Laws: sizes of shards are near equal (`bytes`), as far as single slots allow: what a shard has over another is less than
the smallest slot that went to it last, but where one slot holds more than a fair share. Rows that share a doc_id, or
have none, differ by their texts' hash; only rows equal in doc_id and text share a slot for sure, and these can be as
many as they like. Null text counts as empty: size 1, checksum 0. Ties in a slot go by doc_id (null first), size and
checksum. An empty table gives an empty result and a map of empty slots; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import new_path, staged

SLOTS, SHARDS = 4096, 16
MAX_SLOTS = 65_536
MAP = ["virtual_slot", "shard", "bytes", "rows"]


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row."""
    if not 0 < slots <= MAX_SLOTS:
        raise ValueError(f"from 1 to {MAX_SLOTS} slots")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows of every slot, of those without records as well."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").fillna(0, ["bytes", "rows"])


def _dealt(slots: DataFrame, shards: int) -> DataFrame:
    """(virtual_slot, shard, bytes, rows) with a shard for those whose shard is null: largest first, to the shard with the
    least so far. A slot counts a byte more than it has, so that empty ones are dealt out as well."""
    one = slots.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("all"))
    weight = lambda x: 1 - x["less"]
    load = lambda k: F.aggregate(F.filter("all", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda a, x: a + weight(x))
    loads = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(load(k).alias("load"), k.alias("shard"))))

    def give(state: Column, x: Column) -> Column:
        least = state["loads"][0]
        now = F.struct((least["load"] + weight(x)).alias("load"), least["shard"].alias("shard"))
        return F.struct(
            F.array_sort(F.concat(F.array(now), F.slice(state["loads"], 2, max(shards - 1, 1)))).alias("loads"),
            F.concat(state["given"], F.array(F.struct(x["virtual_slot"].alias("virtual_slot"), least["shard"].alias("to")))).alias("given"),
        )

    none = F.array().cast("array<struct<virtual_slot:int,to:int>>")
    given = one.select(F.aggregate(F.filter("all", lambda x: x["shard"].isNull()), F.struct(loads.alias("loads"), none.alias("given")), give)["given"].alias("given"))
    new = given.select(F.explode("given").alias("g")).select("g.*")
    return slots.join(F.broadcast(new), "virtual_slot", "left").select("virtual_slot", F.coalesce("shard", "to").alias("shard"), "bytes", "rows")


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    return _dealt(sizes.select("virtual_slot", F.lit(None).cast("int").alias("shard"), "bytes", "rows"), shards)


def rebalanced(current: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map for new sizes or another number of shards. A shard keeps its slots, largest first, up to its fair share;
    the others, and those of shards that are gone, are dealt out again."""
    now = current.select("virtual_slot", "shard").join(sizes, "virtual_slot")
    fair = F.ceil(F.sum(F.col("bytes") + 1).over(Window.partitionBy(F.lit(0))) / shards)
    most = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    now = now.withColumns({"_fair": fair, "_sum": F.sum(F.col("bytes") + 1).over(most)})
    stays = (F.col("shard") < shards) & (F.col("_sum") <= F.col("_fair"))
    return _dealt(now.select("virtual_slot", F.when(stays, F.col("shard")).alias("shard"), "bytes", "rows"), shards)


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a folder that were written whole."""
    fs, path = _fs(spark, folder)
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("version=") and fs.exists(_fs(spark, f"{p}/_SUCCESS")[1]))


def store_map(table: DataFrame, folder: str) -> int:
    """Writes the map as the next version. Of two that write the same number at once, one fails."""
    version = max(versions(table.sparkSession, folder), default=0) + 1
    table.select(*MAP).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return version


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard, bytes, rows of a version, by default the last."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise ValueError(f"{folder} has the versions {known}")
    return spark.read.schema("virtual_slot int, shard int, bytes long, rows long").parquet(f"{folder}/version={known[-1] if version is None else version}")


def placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0 without a gap). table: a map made from the sizes
    of these very rows."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("_k", within).join(F.broadcast(starts), "virtual_slot").select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_k") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(records(spark.read.parquet(f"{sf_dir}/documents.parquet")), "records")
    folder = new_path(spark, "shard-map")
    store_map(first_map(slot_sizes(rows)), folder)
    got = placed(rows, load_map(spark, folder))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
