"""The lookup cache as a table: upsert by latest row, reads by key before expiry."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CACHE

TTL, DISCOGRAPHY_TTL = 604_800, 2_419_200
#: Partitions of a stored cache; a large one takes more.
SHARDS = 8


def entry(rows: DataFrame, now: Column, ttl: int = TTL) -> DataFrame:
    """Cache rows of (key, value_json) stored now; null values, that is misses, are not cached."""
    return rows.where("value_json IS NOT NULL").select("key", "value_json", now.alias("stored_at"), (now + F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)"))).alias("expires_at"))


def latest(cache: DataFrame, keys: list[str] | None = None, at: str = "stored_at", tie: str = "value_json") -> DataFrame:
    w = Window.partitionBy(*(keys or ["key"])).orderBy(F.desc(at), F.desc(tie))
    return cache.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    return latest(cache.unionByName(new))


def lookup(requests: DataFrame, cache: DataFrame, now: Column, bypass: bool = False) -> DataFrame:
    """Requests with value_json of the live entry of their key; null where there is none or the cache is bypassed."""
    if bypass:
        return requests.withColumn("value_json", F.lit(None).cast("string"))
    live = latest(cache).where(F.col("expires_at") > now).select("key", "value_json")
    return requests.join(live, "key", "left")


def shard(key: Column | str = "key", shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored cache (key, value_json, stored_at, expires_at, shard); empty where nothing is stored yet."""
    schema = f"{CACHE}, shard int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store(new: DataFrame, path: str, now: Column, shards: int = SHARDS) -> list[int]:
    """Upsert cache rows into the table at path, whose partitions are hash shards; gives the shards that new rows touch.

    Only those are read and written again, without entries that have expired; the files of the others stay.  A shard whose
    entries have all expired stays as it is until one of its keys is stored again (``lookup`` goes by expires_at).
    The number of shards must not change while a table lives.
    """
    spark = new.sparkSession
    dealt = new.select("key", "value_json", "stored_at", "expires_at", shard("key", shards).alias("shard"))
    touched = sorted(r.shard for r in dealt.select("shard").distinct().collect())  # at most so many as there are shards
    if touched:
        kept = upsert(load(spark, path).where(F.col("shard").isin(touched)), dealt).where(F.col("expires_at") > now)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return touched


def changes(rows: DataFrame) -> DataFrame:
    """(key, at, change, value_json) of a cache's life: each row is put when it is stored, and expires unless its key is stored again by then.

    Of rows of one key and moment the one with the greatest value counts.  ``streaming.cache_changes`` gives the same from a stream.
    """
    put = latest(rows, ["key", "stored_at"])
    again = F.lead("stored_at").over(Window.partitionBy("key").orderBy("stored_at"))
    gone = put.withColumn("_again", again).where("_again IS NULL OR _again > expires_at")
    puts = put.select("key", F.col("stored_at").alias("at"), F.lit("put").alias("change"), "value_json")
    return puts.union(gone.select("key", F.col("expires_at").alias("at"), F.lit("expired").alias("change"), F.lit(None).cast("string").alias("value_json")))
