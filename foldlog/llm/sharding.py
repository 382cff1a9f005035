"""Proportional stratified interleaving: every shard gets the same mixture of strata.

Rows of a stratum are shuffled by a seeded digest and ranked; a row's place is its fractional rank
``(2 r - 1) / (2 n)`` in its stratum of n rows. All rows sorted by that place are cut into runs whose lengths
differ by one at most (law ``rows``), so a stratum's share of a shard is its share of the whole, give or take a
row. DataFrame functions only.

Neither ranking gathers a stratum, nor the whole, in a task: digests and fractional ranks are uniform, so both
orders are cut into buckets of about ``bucket_rows`` rows that are ranked apart. The first ranking adds the counts
of the buckets before; for the second those counts follow from the strata's sizes by arithmetic. A stratum that
holds most rows only has more rows in each bucket, and so has one id that many rows bear: the digest is that of id,
size and checksum. Texts are read once: what is ranked and counted is a written table of ids, sizes and checksums
(with carried columns, which would make it a copy of the input, it is read twice instead).

Equal texts are rows like others and may stand in different shards: the law counts rows, and a group of copies may
be larger than a shard.

Defined cases: a null text counts as empty; a null stratum is a stratum; a null id is an id. Rows that are equal in
id, size and checksum may swap places, and they share a bucket. An empty table gives no rows. Further columns are
ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlog.llm import kit

#: Rows that a ranking task has at a time.
BUCKET_ROWS = 50_000


def text_size(text: Column, overhead: int = 16) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def interleave(df: DataFrame, n_shards: int, *, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", carry: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id, size, text_crc32, stratum, shard, slot and, if any are to be carried, struct ``row`` of those columns."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(stratum_col).cast("string")), F.lit("n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), text_size(F.col(text_col)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        key.alias("key"), *([F.struct(*carry).alias("row")] if carry else []),
    )
    if not carry:
        rows = kit.Scratch(df.sparkSession, "interleave").cut(rows, "rows")
    n = rows.count()
    spans = max(1, -(-n // bucket_rows))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), "size", "text_crc32"))
    bucket = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * spans / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("digest", digest).withColumn("bucket", bucket)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    counts = rows.groupBy("key", "bucket").agg(F.count("*").alias("c"))
    counts = counts.select("key", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(whole).alias("n"))
    kept = ["id", "stratum", "size", "text_crc32", *(["row"] if carry else [])]
    shuffled = Window.partitionBy("key", "bucket").orderBy("digest", F.col("id").asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("k", F.row_number().over(shuffled)).join(counts, ["key", "bucket"])
    ranked = ranked.select(*kept, "key", "n", (F.col("offset") + F.col("k")).alias("r"))

    place = F.expr(f"((2 * r - 1) * {spans}L) div (2 * n)")
    of = counts.groupBy("key").agg(F.first("n").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("j"))
    earlier = of.groupBy(F.col("j").cast("long").alias("span")).agg(F.sum(F.expr(f"((2 * n * j + {spans - 1}L) div {spans}L) div 2")).alias("first"))
    order = Window.partitionBy("span").orderBy(((2 * F.col("r") - 1) / (2 * F.col("n"))).asc(), "key", "r")
    placed = ranked.withColumn("span", place).withColumn("k", F.row_number().over(order)).join(earlier, "span")
    placed = placed.withColumn("at", F.col("first") + F.col("k") - 1).withColumn("shard", F.expr(f"(at * {n_shards}L) div {max(n, 1)}L"))
    slot = F.expr(f"at - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)")
    return placed.select(*kept, F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write all columns of df below path, one folder ``shard=k`` each, rows in order of their slot."""
    placed = interleave(df, n_shards, carry=tuple(df.columns), **options)
    placed.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("shard_id")).write.partitionBy("shard_id").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    placed = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"),
    )
