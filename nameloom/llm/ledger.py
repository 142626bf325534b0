"""Records that differ only in formatting, counted batch by batch (problem 1).

The ledger holds one row for each canonical record: its key, the number of
copies and the earliest representative. It is bucketed by key. A batch is first
aggregated by key (combined before the shuffle, so a third of all rows in one
group costs nothing more), then full-outer-joined with only those buckets it
touches; counts add up and the smaller ord stays the representative. A bucket's
new state is written beside the old one and a manifest names the current version
of each bucket, so a lost executor or driver leaves the last state whole.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.operators import scratch
from nameloom.operators.skew import salted_join

_IGNORED = r"[\p{IsWhite_Space}\x1c-\x1f\p{P}]+"
_STATE = "bucket int, key binary, n bigint, first struct<ord:bigint,name1:string,name2:string>"


def bare(c: Column) -> Column:
    """Without white space, punctuation (categories P*) and letter case; nothing else is changed."""
    # upper case first unites letters that lower case keeps apart; with the removal in between, no rule drops that step
    return F.lower(F.regexp_replace(F.upper(c), _IGNORED, ""))


def record_key(name1: Column, name2: Column) -> Column:
    """128-bit key of the record, equal for both orders of the names; null if a name is null."""
    a, b = bare(name1), bare(name2)
    key = F.unhex(F.md5(F.concat(F.least(a, b), F.lit("\x00"), F.greatest(a, b))))
    return F.when(a.isNotNull() & b.isNotNull(), key)  # least and greatest pass over nulls


def keyed(df: DataFrame) -> DataFrame:
    """(key, first) of the rows of df (ord, name1, name2): the record's key and the row itself. Rows with a null name or ord are no records and are left out."""
    return df.select(record_key(F.col("name1"), F.col("name2")).alias("key"), F.struct("ord", "name1", "name2").alias("first")).where("key is not null and first.ord is not null")


class CopyLedger:
    """The ledger at `path`. buckets: fixed at creation; a bucket should fit a task (thousands for billions of records)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.current: dict[int, int] = {}
        self.version = 0
        if scratch.exists(spark, f"{path}/manifest"):
            rows = spark.read.parquet(f"{path}/manifest").collect()  # one row a bucket and version
            done = max(r.version for r in rows)
            self.current, self.version = {r.bucket: r.at for r in rows if r.version == done}, done

    def state(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of the buckets in `only`, or of all."""
        paths = [f"{self.path}/v{self.current[b]}/bucket={b}" for b in sorted(self.current if only is None else set(only) & set(self.current))]
        schema = _STATE.split(", ", 1)[1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, batch: DataFrame) -> None:
        """Adds a batch with columns ord, name1, name2."""
        self.add(keyed(batch))

    def add(self, rows: DataFrame) -> None:
        """Adds a batch of rows that `keyed` gave."""
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        counted = counted.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        new = scratch.write(counted, "ledger-batch")
        touched = [r.bucket for r in new.df.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = self.state(touched).select("key", F.col("n").alias("n0"), F.col("first").alias("first0"))
            merged = new.df.drop("bucket").join(old, "key", "full_outer").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), F.least("first", "first0").alias("first"))
            merged = merged.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
            self.version += 1
            merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/v{self.version}")
            self.current |= dict.fromkeys(touched, self.version)
            manifest = [(self.version, b, v) for b, v in self.current.items()]
            self.spark.createDataFrame(manifest, "version int, bucket int, at int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        new.drop()

    def vacuum(self) -> None:
        """Deletes versions that no bucket refers to any more."""
        for v in range(1, self.version + 1):
            if v not in self.current.values():
                scratch.delete(self.spark, f"{self.path}/v{v}")


def build_ledger(df: DataFrame, batches: int = 3, buckets: int = 32, path: str | None = None) -> CopyLedger:
    """A ledger of df (ord, name1, name2), fed in `batches` ranges of ord as they would arrive."""
    return _build(scratch.write(keyed(df), "keyed").df, batches, buckets, path)


def _build(rows: DataFrame, batches: int = 3, buckets: int = 32, path: str | None = None) -> CopyLedger:
    spark = rows.sparkSession
    ledger = CopyLedger(spark, path or scratch.new_path(spark, "ledger"), buckets)
    low, high = rows.agg(F.min("first.ord"), F.max("first.ord")).first()
    if low is None:
        return ledger
    cuts = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
    for a, b in zip(cuts, cuts[1:]):
        ledger.add(rows.where((F.col("first.ord") >= a) & (F.col("first.ord") < b)))
    ledger.vacuum()
    return ledger


def found_copies(df: DataFrame) -> DataFrame:
    """(first_ord, copy_ord) of df (ord, name1, name2): the ledger is fed with it, then every row meets the ledger. The keys are made once."""
    rows = scratch.write(keyed(df), "keyed")
    return _copies(rows.df, rows.stats["rows"], _build(rows.df))


def records(ledger: CopyLedger) -> DataFrame:
    """(first_ord, name1, name2, copies): one row for each record, with its earliest row as written."""
    return ledger.state().select(F.col("first.ord").alias("first_ord"), "first.name1", "first.name2", F.col("n").alias("copies"))


def copies(df: DataFrame, ledger: CopyLedger) -> DataFrame:
    """(first_ord, copy_ord): one row for each row of df that is a later copy of a record of the ledger.

    Nulls in a name: no row. Empty names are names. Repeated ords are one row each.
    A record with a third of all copies is split by salted_join.
    """
    return _copies(keyed(df), df.count(), ledger)


def _copies(rows: DataFrame, total: int, ledger: CopyLedger) -> DataFrame:
    mine = rows.select("key", F.col("first.ord").alias("copy_ord"))
    several = ledger.state().where("n > 1").select("key", F.col("first.ord").alias("first_ord"))
    return salted_join(mine, several, "key", total, F.col("copy_ord")).where("copy_ord <> first_ord").select("first_ord", "copy_ord")
