"""Sharding by a two-pass external shuffle.

First pass: each record goes to one of the buckets, sized to memory, that a seeded hash of its id, text and copy number
gives it. Second pass: each bucket is put in a fixed order and shuffled whole (Spark's ``shuffle`` is the Fisher-Yates
algorithm under a seed). Buckets laid end to end are a random order of all records; record g of it goes to shard g mod n
at slot g div n. So the law is ``rows``: shard sizes differ by one record at most, and slots have no gaps.

The result depends on the records, the seed and ``bucket_bytes`` alone, not on how the input or the session is
partitioned: the number of partitions of the second pass follows the number of buckets, a partition takes its buckets in
order, and its generator starts from the seed and its number. A lost task is run again to the same end.

Records that repeat are counted before they are moved, so that a record with many copies crosses the first exchange once
a task; its copies then get numbers and spread over all buckets.

Everything runs in DataFrame operations. One scan of the text sizes sets the number of buckets of about ``BUCKET_BYTES``
(2^``RANGES`` at most; beyond, which is 16 TB, buckets grow).

Defined results: a null text counts no bytes and has the checksum of an empty one; repeated rows are records like any
other; an empty table gives no rows. Columns of map type cannot be compared and are not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.llm import common

SHARDS = 40
SEED = 17
BUCKET_BYTES = 16 << 20
#: The most and the fewest buckets, as powers of two.
RANGES, LEAST = 20, 6
#: Tasks of the second pass at most; beyond, each takes several buckets.
PARTITIONS = 1 << 14


def shuffled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with shard and slot (columns of these names are replaced)."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    names = [f"c{i}" for i in range(len(kept))]
    id_name, text_name = (names[kept.index(c)] for c in (id_col, text_col))
    counted = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True))).groupBy(*names).agg(F.count("*").alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    rows = copies.withColumn("place", F.xxhash64(F.lit(seed), id_name, text_name, "copy")).withColumn("range", F.shiftrightunsigned("place", 64 - RANGES))
    total = df.agg(F.sum(F.octet_length(common.text_of(text_col)))).first()[0] or 0
    bits = min(RANGES, max(LEAST, (total // bucket_bytes).bit_length()))
    bucket = F.shiftright("range", RANGES - bits)
    record = F.struct("place", *names)
    # Buckets by number, so that the generator of a partition meets the same buckets in the same order each time.
    dealt = rows.select(bucket.alias("bucket"), record.alias("record")).repartition(min(1 << bits, PARTITIONS), "bucket")
    mixed = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("held")).sortWithinPartitions("bucket").select("bucket", F.shuffle("held", seed).alias("held"))
    # A row for each bucket, 2^RANGES at most: few enough for one window and a broadcast.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    laid = mixed.join(F.broadcast(firsts), "bucket").select("first", F.posexplode("held").alias("at", "x")).withColumn("g", F.col("first") + F.col("at"))
    return laid.select(*(F.col("x")[n].alias(c) for n, c in zip(names, kept, strict=True)), F.pmod("g", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("g") / shards).cast("long").alias("slot"))


def write_shards(out: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes shards as folders, each sorted by slot."""
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffled(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = common.text_of("text")
    return out.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
