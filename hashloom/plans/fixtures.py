"""Engine tables derived from the relational test tables. Source ids start at 0, and id 0 is reserved, so every id is one more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.ints import let
from hashloom.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(hash, id)``: parts of orders as postings, repeated ones kept."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("hash"), (F.col("l_orderkey") + 1).alias("id"))


def basket_queries(spark: SparkSession, sf_dir: str, order: int | None = None, repeat: int = 1) -> DataFrame:
    """Parts of every fiftieth order, or of one order, as queries; each list is repeated ``repeat`` times."""
    chosen = F.col("l_orderkey") % 50 == 0 if order is None else F.col("l_orderkey") == order
    lists = table(spark, sf_dir, "lineitem").where(chosen).groupBy((F.col("l_orderkey") + 1).alias("query_id")).agg(F.collect_list("l_partkey").alias("hashes"))
    return lists.select("query_id", F.flatten(F.array_repeat("hashes", repeat)).alias("hashes"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of events: 100 operations a commit, errors delete."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    hashes = F.array(F.round(F.col("value") * 100).cast("bigint"), k + 1_000_000, F.hour("ts").cast("bigint") + 2_000_000)
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), (F.floor(F.col("event_id") / 100) + 1).cast("bigint").alias("commit_id"), (F.col("event_id") + 1).alias("ordinal"),
        (F.col("user_id") + 1).alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), hashes.alias("hashes"),
    )


def shingle_docs(rows: DataFrame, item: str) -> DataFrame:
    """``(id, hashes)``: one hash for each three words of ``text``; texts of fewer words have none."""
    shingle = lambda w, i: F.conv(F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, 3))), 1, 8), 16, 10).cast("bigint")
    none = F.array().cast("array<bigint>")
    every = lambda w: F.when(F.size(w) < 3, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: shingle(w, i)))
    words = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")), " ")
    return spread(rows.where("text is not null").select(item, "text")).select((F.col(item) + 1).alias("id"), let(words, every).alias("hashes"))


def signed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(hash, id)``: four rows for each vector, one for each 16 signs."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding")
    bands = []
    for band in range(4):
        bits = sum((F.when(F.element_at("embedding", band * 16 + i + 1) > 0, F.lit(2**i)).otherwise(F.lit(0)) for i in range(16)), F.lit(band * 65536))
        bands.append(bits.cast("bigint"))
    return rows.select(F.explode(F.array(*bands)).alias("hash"), "id")


def region_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    return joined.select(F.lit(1).alias("commit_id"), F.col("n_nationkey").alias("ordinal"), F.col("r_name").alias("key"), F.col("n_name").alias("value"))


def user_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), kind.alias("kind"), F.concat(F.lit("u"), F.col("user_id")).alias("index_name"))
    return rows.where("kind is not null")


def supplier_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("http://peer-"), F.col("s_suppkey")).alias("base_url"), (F.col("s_nationkey") % 3 + 1).cast("bigint").alias("generation"),
        F.floor(F.abs("s_acctbal")).cast("bigint").alias("file_version"), (F.col("s_acctbal") > 0).alias("ok"),
    )
