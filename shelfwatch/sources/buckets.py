"""Tables kept in hash buckets, of which a change set rewrites only those it touches.

Rows lie in folders ``data/version=N/_bucket=K``. The manifest of a version (one document under ``versions``) names for
each bucket the folder that holds it, so a version shares the untouched buckets with the ones before. A version counts
once its manifest is there, and folders it names are never written again: readers of an older version go on undisturbed,
and a run that dies leaves at most folders no manifest names. One writer at a time.

What reaches the driver is one manifest and the numbers of the touched buckets, each as one row with at most one entry a
bucket; the number of buckets (fixed when the table is made) bounds both. With ``group`` (SQL over the key columns, as
the host of a url) the rows of one group lie in ``spread`` neighbouring buckets; changes that come by group then touch few
of them, and a hot group still has ``spread``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwatch.functions.urls import url_hash
from shelfwatch.session import staged

_MANIFEST = "folders map<string, string>, version bigint"


class BucketTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        made = json.loads(spark.read.text(f"{self.path}/table").first().value)
        self.schema = StructType.fromJson(made["schema"])
        self.keys, self.buckets, self.group, self.spread = made["keys"], made["buckets"], made["group"], made["spread"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = 1024, group: str | None = None,
               spread: int | None = None) -> BucketTable:
        """Write ``rows`` as version 0. Null keys are keys like others."""
        about = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "group": group,
                 "spread": spread or max(1, buckets // 8)}
        spark = rows.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/table")
        table = cls(spark, path)
        table._commit(table._write(rows, 0), 0)
        return table

    def bucket(self) -> Column:
        own = F.xxhash64(*[F.col(k) for k in self.keys])
        if self.group is None:
            return F.pmod(own, F.lit(self.buckets)).cast("int")
        first = F.pmod(F.xxhash64(F.expr(self.group)), F.lit(self.buckets))
        return F.pmod(first + F.pmod(own, F.lit(self.spread)), F.lit(self.buckets)).cast("int")

    def version(self, at: int | None = None) -> int:
        """The newest version, or the newest that is not after ``at``."""
        rows = self._manifests()
        return (rows if at is None else rows.filter(F.col("version") <= at)).agg(F.max("version")).first()[0]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        entries = self.manifest(self.version() if version is None else version)
        wanted = entries if buckets is None else {b: entries[b] for b in buckets if b in entries}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in wanted.values()])

    def manifest(self, version: int) -> dict[int, str]:
        """Bucket to folder; buckets without rows are left out."""
        found = self._manifests().filter(F.col("version") == version).first()
        return {int(b): f for b, f in found.folders.items()} if found else {}

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets the keys of ``changes`` lie in, at most as many as the table has."""
        return self._numbers(changes.select(self.bucket().alias("_bucket")))

    def upsert(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], at: int | None = None) -> int:
        """Next version: ``merge(stored rows, changes)`` over the touched buckets, the rest as it is.

        ``merge`` may be any operator that works key by key, as the upserts of :mod:`shelfwatch.operators.changes`; rows
        it leaves out are deleted. With ``at`` the version after the newest one up to ``at`` is made as version
        ``at + 1``, over what an earlier try has left, so that a repeated micro-batch counts once. No changes: the
        version stays, unless ``at`` asks for a new one.
        """
        base = self.version(at)
        changes = staged(changes, "changes")
        touched = self.touched(changes)
        if not touched and at is None:
            return base
        new = base + 1 if at is None else at + 1
        entries = {b: f for b, f in self.manifest(base).items() if b not in set(touched)}
        if touched:
            entries |= self._write(merge(self.read(base, touched), changes), new)
        self._commit(entries, new)
        return new

    def _write(self, rows: DataFrame, version: int) -> dict[int, str]:
        folder = f"data/version={version}"
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        (rows.select(*fields).withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
         .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}"))
        written = self._numbers(self.spark.read.schema("_bucket int").parquet(f"{self.path}/{folder}"))
        return {b: f"{folder}/_bucket={b}" for b in written}

    @staticmethod
    def _numbers(rows: DataFrame) -> list[int]:
        """The distinct ``_bucket`` numbers, a set no larger than the table has buckets."""
        return rows.agg(F.sort_array(F.collect_set("_bucket"))).first()[0]

    def _commit(self, entries: dict[int, str], version: int) -> None:
        (self.spark.createDataFrame([({str(b): f for b, f in sorted(entries.items())},)], "folders map<string, string>").coalesce(1)
         .write.mode("overwrite").json(f"{self.path}/versions/version={version}"))

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/versions")


class PageStore:
    """Newest page per url. Bodies are written once and never move; what changes is a narrow index.

    The index (a :class:`BucketTable` by url hash) says which batch holds a url's body. Storing pages writes the bodies
    that are newer than what is stored, and the touched buckets of the index; counting accesses writes index buckets only.
    """

    INDEX = ("url_hash string, url string, retailer string, cached_at timestamp_ntz, accessed_count bigint, "
             "last_accessed timestamp_ntz, batch bigint")

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024):
        self.spark, self.path = spark, path.rstrip("/")
        empty = spark.createDataFrame([], self.INDEX)
        self.index = BucketTable.create(empty, f"{self.path}/index", ["url_hash"], buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageStore:
        store = cls.__new__(cls)
        store.spark, store.path = spark, path.rstrip("/")
        store.index = BucketTable(spark, f"{store.path}/index")
        return store

    def put(self, fetched: DataFrame) -> int:
        """Store pages (url, retailer, html, cached_at). The newest page of a url stays; at equal times the arriving one.

        Of a url's pages of one time that of the largest hash is taken. Pages without a time count as oldest, pages
        without a url are not stored. ``fetched`` is read twice, first without the bodies.
        """
        rows = fetched.filter(F.col("url").isNotNull()).select(
            url_hash(F.col("url")).alias("url_hash"), "url", "retailer", "html",
            F.col("cached_at").cast("timestamp_ntz").alias("cached_at"), F.xxhash64("html", "retailer").alias("_body"))
        best = rows.groupBy("url_hash").agg(F.max(F.struct("cached_at", "_body", "url", "retailer")).alias("m")).select("url_hash", "m.*")
        version = self.index.version()
        held = self.index.read(version, self.index.touched(best)).select("url_hash", F.col("cached_at").alias("_held"), F.lit(True).alias("_known"))
        newer = F.col("_known").isNull() | F.col("_held").isNull() | (F.col("cached_at") >= F.col("_held"))
        won = staged(best.join(held, "url_hash", "left").filter(newer).drop("_held", "_known"), "pages")
        number = version + 1
        chosen = won.select("url_hash", "_body", F.col("cached_at").alias("_at"))
        match = (rows["url_hash"] == chosen["url_hash"]) & (rows["_body"] == chosen["_body"]) & rows["cached_at"].eqNullSafe(chosen["_at"])
        bodies = rows.join(chosen, match, "left_semi").select("url_hash", "html").dropDuplicates(["url_hash"])
        bodies.write.mode("overwrite").parquet(f"{self.path}/bodies/batch={number}")
        fresh = won.select("url_hash", "url", "retailer", "cached_at", F.lit(1).cast("long").alias("accessed_count"),
                           F.col("cached_at").alias("last_accessed"), F.lit(number).cast("long").alias("batch"))
        return self.index.upsert(fresh, lambda old, new: old.join(new, "url_hash", "left_anti").unionByName(new))

    def count_accesses(self, reads: DataFrame, age: str = "24 HOURS") -> int:
        """Count reads (url, read_at) of stored pages that were younger than ``age`` when they were read."""
        asked = reads.select(url_hash(F.col("url")).alias("url_hash"), F.col("read_at").cast("timestamp_ntz").alias("read_at"))

        def merge(old, new):
            hits = (new.join(old.select("url_hash", "cached_at"), "url_hash")
                    .filter(F.col("cached_at") > F.col("read_at") - F.expr(f"INTERVAL {age}"))
                    .groupBy("url_hash").agg(F.count(F.lit(1)).alias("_n"), F.max("read_at").alias("_at")))
            return old.join(hits, "url_hash", "left").withColumns({
                "accessed_count": F.col("accessed_count") + F.coalesce("_n", F.lit(0)),
                "last_accessed": F.greatest("last_accessed", "_at")}).drop("_n", "_at")

        return self.index.upsert(asked, merge)

    def pages(self, version: int | None = None) -> DataFrame:
        """Index columns and html of every stored page."""
        bodies = self.spark.read.schema("url_hash string, html string, batch bigint").parquet(f"{self.path}/bodies")
        return self.index.read(version).join(bodies, ["url_hash", "batch"]).drop("batch")
