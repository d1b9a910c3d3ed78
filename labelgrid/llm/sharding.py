"""Sharding by extendible hashing, in DataFrame operations only.

A key's hash bits address a directory.  A bucket is a prefix of those bits; a
bucket over the byte limit splits on the next bit, all others stay as they are,
until every bucket fits.  The sizes of all prefixes of a level come from one
aggregate; only rows of buckets that are still too large go on to deeper levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.plans.materialize import materialize

KEY_BITS, ROW_BITS = 36, 24
BITS = KEY_BITS + ROW_BITS
#: Levels that one aggregate covers below the expected depth.
STEP = 4


def _prefix(depth: Column | int) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftright", F.col("h"), F.lit(BITS) - depth)


def extendible_shards(df: DataFrame, key: str, n_bytes: Column, limit: int) -> DataFrame:
    """``key, n_bytes, shard, depth, shard_bytes, oversized`` for each row of ``df``.

    ``shard`` is the bucket's bit prefix ("" when all fits one shard).  The first 36 bits come from the
    key, so a key keeps its place as the corpus is re-read; the last 24 from the row, which only parts
    rows of one key (repeated rows, NULL keys) when they alone exceed the limit.  A row larger than the
    limit gets a shard of its own, marked ``oversized``; NULL sizes count as 0; an empty frame gives no rows.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    high = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")
    low = F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, ROW_BITS // 4), 16, 10).cast("long")
    rows = df.select(F.col(key).alias("key"), F.coalesce(n_bytes.cast("long"), F.lit(0).cast("long")).alias("n_bytes"), (high * F.lit(1 << ROW_BITS) + low).alias("h"))
    rest = materialize(rows, "shard-keys")  # the row part of the hash must not change between passes
    alone = rest.where(F.col("n_bytes") > limit)
    done = [alone.select("key", "n_bytes", F.concat(_bits(F.lit(BITS)), F.lit("!")).alias("shard"), F.lit(BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("oversized"))]
    rest = rest.where(F.col("n_bytes") <= limit)
    total = rest.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return _named(done, key)
    base, deep = -1, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + STEP)
    while True:
        # Sizes of the prefixes at the deepest level of this pass, then of all their own prefixes.
        level = rest.groupBy(_prefix(deep).alias("p")).agg(F.sum("n_bytes").alias("b"))
        up = level.select("p", "b", F.explode(F.sequence(F.lit(base + 1), F.lit(deep))).alias("depth"))
        up = up.withColumn("q", F.call_function("shiftright", "p", F.lit(deep) - F.col("depth")))
        sums = up.groupBy("depth", "q").agg(F.sum("b").alias("shard_bytes"))
        fits = up.join(sums, ["depth", "q"]).where(F.col("shard_bytes") <= limit)
        # The shallowest prefix that fits is the bucket: its parent was split for being too large.
        found = materialize(fits.groupBy("p").agg(F.min(F.struct("depth", "shard_bytes")).alias("s")), "shard-directory")
        placed = rest.withColumn("p", _prefix(deep)).join(found, "p", "left")
        done.append(placed.where(F.col("s").isNotNull()).select("key", "n_bytes", _bits(F.col("s.depth")).alias("shard"), F.col("s.depth").alias("depth"), F.col("s.shard_bytes").alias("shard_bytes"), F.lit(False).alias("oversized")))
        over = level.where(F.col("b") > limit)
        if over.isEmpty():
            return _named(done, key)
        if deep == BITS:
            # Rows that share all 60 bits and together exceed the limit; a shard each keeps the limit.
            left = placed.where(F.col("s").isNull())
            done.append(left.select("key", "n_bytes", F.concat(_bits(F.lit(BITS)), F.lit("#"), F.monotonically_increasing_id().cast("string")).alias("shard"), F.lit(BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(False).alias("oversized")))
            return _named(done, key)
        rest = materialize(placed.where(F.col("s").isNull()).select("key", "n_bytes", "h"), "shard-rest")
        base, deep = deep, min(BITS, deep + STEP)


def _bits(depth: Column) -> Column:
    return F.substring(F.lpad(F.bin("h"), BITS, "0"), F.lit(1), depth)


def _named(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("key").alias(key), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "oversized")


def write_shards(df: DataFrame, key: str, shards: DataFrame, path: str) -> None:
    """Write the rows of ``df`` (unique keys) as one directory per shard."""
    named = shards.select(F.col(key).alias("shard_key"), F.concat(F.lit("s"), "shard").alias("shard"))
    joined = df.join(named, F.col(key).eqNullSafe(F.col("shard_key"))).drop("shard_key")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)
