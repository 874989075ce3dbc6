"""A/B tests: arms that own buckets of users, and the states of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Users are hashed to so many buckets; the table of a test's buckets has a row for each.
BUCKETS = 10_000


def bucket_of(user: Column, test: str) -> Column:
    """A user's bucket in a test, from an MD5 hash; tests deal users independently."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{test}:"), user.cast("string"))), 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def new_test(spark: SparkSession, champion: str = "champion") -> DataFrame:
    """``bucket``, ``arm``: all belongs to the champion."""
    return spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(champion).alias("arm"))


def reshared(buckets: DataFrame, shares: dict[str, float], champion: str = "champion") -> DataFrame:
    """The table of buckets after arms' shares have changed. Arms that are not named keep theirs.

    An arm that shrinks gives its last buckets to the champion, one that grows takes the champion's first ones: users move between that
    arm and the champion only, never between challengers, and those who are in an arm that grows stay. Each share is held to a
    bucket. The work is on ``BUCKETS`` rows.
    """
    if any(s < 0 for s in shares.values()) or champion in shares:
        raise ValueError("shares are of challengers, and not negative")
    want = {a: round(s * BUCKETS) for a, s in shares.items()}
    rank = F.row_number().over(Window.partitionBy("arm").orderBy("bucket"))
    wanted = F.lit(None).cast("int")
    for a, n in want.items():
        wanted = F.when(F.col("arm") == a, F.lit(n)).otherwise(wanted)
    x = buckets.withColumn("arm", F.when(rank > wanted, F.lit(champion)).otherwise(F.col("arm")))
    have = {r.arm: r.n for r in x.groupBy("arm").agg(F.count("*").alias("n")).collect()}  # a row an arm
    lacks = [(a, n - have.get(a, 0)) for a, n in want.items() if n > have.get(a, 0)]
    if sum(n for _, n in lacks) > have.get(champion, 0):
        raise ValueError("the champion has no share left to give")
    x, taken, free = x.withColumn("_k", F.row_number().over(Window.partitionBy("arm").orderBy("bucket"))), 0, F.col("arm")
    for a, n in lacks:
        free = F.when((F.col("arm") == champion) & (F.col("_k") > taken) & (F.col("_k") <= taken + n), F.lit(a)).otherwise(free)
        taken += n
    return x.select("bucket", free.alias("arm"))


def assigned(users: DataFrame, buckets: DataFrame, test: str, user_col: str) -> DataFrame:
    """``users`` with their ``arm``; the table of buckets, ``BUCKETS`` rows, is broadcast."""
    return users.withColumn("bucket", bucket_of(F.col(user_col), test)).join(F.broadcast(buckets), "bucket").drop("bucket")


def started(tests: DataFrame, model: str, champion: str, challenger: str, share: float, hours: int, now: Column) -> DataFrame:
    """The table of tests with a new active one; a model has one active test."""
    row = tests.sparkSession.range(1).select(F.lit(model).alias("model"), F.lit(champion).alias("champion"), F.lit(challenger).alias("challenger"), F.lit(share).alias("share"), now.alias("started_at"), (now + F.make_interval(hours=F.lit(hours))).alias("ends_at"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit(False).alias("promoted"))
    if not tests.where((F.col("model") == model) & F.col("active")).isEmpty():
        raise ValueError(f"{model} has an active test")
    return tests.unionByName(row)


def ended(tests: DataFrame, model: str, promote: bool, now: Column) -> DataFrame:
    """The table of tests after the model's active test has ended; if promoted, its challenger is the champion from then on (see :func:`champion_of`)."""
    on = (F.col("model") == model) & F.col("active")
    return tests.withColumns({"ended_at": F.when(on, now).otherwise(F.col("ended_at")), "promoted": F.when(on, F.lit(promote)).otherwise(F.col("promoted")), "active": F.col("active") & ~on})


def champion_of(tests: DataFrame) -> DataFrame:
    """Each model's champion: the challenger promoted last, else the first champion."""
    return tests.groupBy("model").agg(F.coalesce(F.max_by(F.when(F.col("promoted"), F.col("challenger")), F.when(F.col("promoted"), F.col("ended_at"))), F.min_by("champion", "started_at")).alias("champion"))
