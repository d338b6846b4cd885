"""Sharding along a Hilbert curve, with DataFrame functions only.

Each row gets a few metadata dimensions, every one quantised to ``2**BITS`` steps:
its size by the quantiles of all sizes, its language and source by hashes.  The
steps give a place on the Hilbert curve, along which neighbours in all dimensions
stay close, so that a run of rows covers a small box and a reader can skip most
files.  Rows are range-sorted by curve index and cut into runs of equal count.

At scale: text is reduced to its size and checksum before anything is shuffled;
one range exchange whose key ends with unique values, so that no group of equal
rows fills a task; ranks come from each partition's row count (one row a
partition), not from one global window.

Law: ``rows``.  Counts of shards differ by one at most.  Edge cases: a null text
has size 16 and the checksum of no bytes; null language, source or id have a step
of their own; equal texts of a cell lie side by side; repeated rows get slots of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import free_name, table

BITS, SHARDS = 5, 40


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str = "hilbert") -> DataFrame:
    """Add the curve index of integer columns with values below 2**bits (Skilling's transform, one projection a step)."""
    n, x = len(dims), [f"_h{i}" for i in range(len(dims))]
    c = F.col
    df = df.withColumns({x[i]: c(d).cast("int") for i, d in enumerate(dims)})
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            on = c(x[i]).bitwiseAND(q) != 0
            swap = c(x[0]).bitwiseXOR(c(x[i])).bitwiseAND(p)
            step = {x[0]: F.when(on, c(x[0]).bitwiseXOR(F.lit(p))).otherwise(c(x[0]).bitwiseXOR(swap))}
            if i:
                step[x[i]] = F.when(on, c(x[i])).otherwise(c(x[i]).bitwiseXOR(swap))
            df = df.withColumns(step)
    for i in range(1, n):
        df = df.withColumn(x[i], c(x[i]).bitwiseXOR(c(x[i - 1])))
    flip = F.lit(0)
    for b in range(bits - 1, 0, -1):
        flip = F.when(c(x[-1]).bitwiseAND(1 << b) != 0, flip.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(flip)
    df = df.withColumn("_flip", flip)
    df = df.withColumns({v: c(v).bitwiseXOR(c("_flip")) for v in x})
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index * 2 + F.shiftright(c(v), b).bitwiseAND(1)
    return df.withColumn(name, index).drop("_flip", *x)


def category_step(name: str, bits: int = BITS) -> Column:
    """A step for a text column: 0 for null, else one of the others by hash."""
    return F.when(F.col(name).isNull(), 0).otherwise(1 + F.crc32(F.col(name).cast("string").cast("binary")) % ((1 << bits) - 1)).cast("int")


def size_steps(sizes: DataFrame, bits: int = BITS) -> list[int]:
    """Sizes at which the quantile step rises, from all rows."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    got = sizes.agg(F.percentile_approx("size", at, 10_000).alias("cuts")).first().cuts
    return sorted(set(got or []))


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    has = lambda n: n if n in docs.columns else None
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), *(category_step(d).alias(f"_{d}") for d in ("lang", "source") if has(d)))
    rows = table(rows)  # read twice below, without the texts
    cuts = F.array(*map(F.lit, size_steps(rows.select("size")))).cast("array<bigint>")
    rows = rows.withColumn("_size", F.size(F.filter(cuts, lambda c: c < F.col("size"))))
    rows = hilbert_index(rows, [d for d in ("_size", "_lang", "_source") if d in rows.columns], BITS)
    keys = ["hilbert", "text_crc32", "doc_id", "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = table(ranged.select("doc_id", "size", "text_crc32", "hilbert", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    shard = F.expr(f"_rank * {shards} div _all")
    return rank.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "hilbert", "shard", F.expr(f"_rank - (shard * _all + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all columns of documents, one folder a shard (shard=0, ...; with underscores before the name where documents have such a column), each in curve order.

    A shard is written by as many tasks as its share of all rows asks for, each a run of the curve.  Rows that
    repeat id and text go to one place; null ids are kept; an empty table gives an empty folder.
    """
    name = free_name(docs, "shard")
    own = f"{name}_own"
    placed = shard_rows(docs, shards).select(F.col("doc_id").alias(f"{own}_id"), F.col("text_crc32").alias(f"{own}_crc"), F.col("shard").alias(name), F.col("slot").alias(f"{own}_slot"))
    placed = placed.groupBy(f"{own}_id", f"{own}_crc").agg(F.min(F.struct(name, f"{own}_slot")).alias(own)).select(f"{own}_id", f"{own}_crc", f"{own}.*")
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.withColumn(f"{own}_text", crc)
    out = keyed.join(placed, keyed["doc_id"].eqNullSafe(placed[f"{own}_id"]) & (keyed[f"{own}_text"] == placed[f"{own}_crc"]))
    ordered = out.repartitionByRange(name, f"{own}_slot").sortWithinPartitions(name, f"{own}_slot")
    ordered.select(*docs.columns, name).write.partitionBy(name).parquet(path)


def op10_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
