"""Joins and links that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_SHARE = 1 / 1000
SALTS = 64


def salt(*cols: Column, n: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def lookup(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", min_rows: int = 1_000_000, rows: int | None = None) -> DataFrame:
    """left join right on key, where right has each key once and left may be skewed.

    Keys with more than HOT_SHARE of left's rows (at most 1 / HOT_SHARE keys, so their rows of right may be broadcast)
    never meet a shuffle; the rest is an ordinary join. Below min_rows no key can hurt and the join is ordinary altogether.
    """
    n = left.count() if rows is None else rows
    if n < min_rows:
        return left.join(right, key, how)
    limit = int(n * HOT_SHARE)
    hot = [r[0] for r in left.groupBy(key).count().where(F.col("count") > limit).where(F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right, key, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how))


def in_blocks(few: DataFrame, many: DataFrame, *, by: str, rows: int, on: Column | None = None, few_name: str = "q", many_name: str = "p", block: int = 50_000) -> DataFrame:
    """Every row of a query set with every row of a table, as `few_name` and `many_name`, or with those for which `on` holds.

    The table stays in parts of about `block` rows, spread by `by`, and the query set is copied to each part: one join, whose
    parts grow with the table (rows: how many it has) and which nothing has to collect.
    """
    tasks = max(2 * few.sparkSession.sparkContext.defaultParallelism, -(-rows // block))
    part = F.explode(F.sequence(F.lit(0), F.lit(3 * tasks - 1)))  # three to a task, so that tasks are of like size
    left = few.withColumn("part", part).repartition(tasks, "part").alias(few_name)
    right = many.withColumn("part", salt(F.col(by), n=3 * tasks)).repartition(tasks, "part").alias(many_name)
    same = F.col(f"{few_name}.part") == F.col(f"{many_name}.part")
    return left.join(right.hint("merge"), same if on is None else same & on)


def star_edges(df: DataFrame, ident: str, key: str, *, salts: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect all rows with equal key, one or two for each row instead of all pairs.

    Rows point to the smallest ident of their part of the key's rows; those minima point to the key's smallest. A key with a
    third of all rows is spread over `salts` parts, by default as many as the session has shuffle partitions, which grow
    with the data. Rows without key or ident make no edge.
    """
    salts = salts or max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = df.select(F.col(key).alias("k"), F.col(ident).alias("src")).where(F.col("k").isNotNull() & F.col("src").isNotNull())
    parts = members.withColumn("s", salt(F.col("src"), n=salts))
    local = parts.withColumn("dst", F.min("src").over(W.partitionBy("k", "s")))
    tops = parts.groupBy("k", "s").agg(F.min("src").alias("src"))
    top = tops.withColumn("dst", F.min("src").over(W.partitionBy("k")))
    return local.select("src", "dst").unionByName(top.select("src", "dst")).where(F.col("src") != F.col("dst"))
