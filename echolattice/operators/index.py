"""The inverted index and the metadata of the indexed resources, as tables.

``postings (hash BIGINT, resource_id INT, t1 INT, f1 INT)`` and ``metadata (resource_id INT, path STRING, duration DOUBLE, num_fingerprints BIGINT)``. On
storage the postings are partitioned by the high bits of the hash (``part``) and range-sorted by hash, resource and time, so a hash with any number of postings spreads over files,
and a lookup reads the folders and row groups its hashes fall into.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echolattice.runtime import Written, shuffle_partitions

POSTING = ("hash", "resource_id", "t1", "f1")
#: Low bits of a hash within one part: 64 parts for hashes of 34 bits.
PART_BITS = 28
#: Most rows of a side that is sent to all tasks, a few dozen bytes each.
MOST_BROADCAST_ROWS = 1_000_000


def part_of(hash_: Column) -> Column:
    return F.shiftright(hash_, PART_BITS).cast("int")


def only_parts(postings: DataFrame, hashes: Written, column: str) -> DataFrame:
    """``postings`` (with ``part``) restricted to the parts that the stored ``hashes`` fall into: at most one number a part comes to the driver, and the scan lists only those folders."""
    parts = [r[0] for r in hashes.df.select(part_of(F.col(column)).alias("p")).distinct().collect()]
    return postings.where(F.col("part").isin([p for p in parts if p is not None]))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its number of rows, is small enough."""
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


def insert_set(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union in which each posting occurs once, however often it is stored."""
    return index.select(*POSTING).unionByName(fresh.select(*POSTING)).dropDuplicates(list(POSTING))


def insert_bag(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Union that keeps repeated postings."""
    return index.select(*POSTING).unionByName(fresh.select(*POSTING))


def _both(index: DataFrame, gone: DataFrame) -> list:
    return [index[c].eqNullSafe(gone[f"_g_{c}"]) for c in POSTING]


def delete(index: DataFrame, prints: DataFrame) -> DataFrame:
    """The index without exactly the given postings."""
    gone = prints.select(*(F.col(c).alias(f"_g_{c}") for c in POSTING)).distinct()
    return index.join(gone, _both(index, gone), "left_anti")


def delete_metadata(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    return metadata.join(ids.select("resource_id"), "resource_id", "left_anti")


def upsert_metadata(metadata: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fresh row wins over the one stored for the same resource."""
    both = metadata.withColumn("_new", F.lit(0)).unionByName(fresh.select(*metadata.columns).withColumn("_new", F.lit(1)))
    w = W.partitionBy("resource_id").orderBy(F.desc("_new"), *(F.col(c) for c in metadata.columns if c != "resource_id"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_new", "_rn")


def lookup(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata of each id, null where the resource isn't indexed."""
    return ids.select("resource_id").join(metadata, "resource_id", "left")


def not_stored(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Resources to be stored: those without metadata. Applied before anything of them is read."""
    return candidates.join(metadata.select("resource_id"), "resource_id", "left_anti")


def stored(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    return candidates.join(metadata.select("resource_id"), "resource_id", "left_semi")


def print_counts(prints: DataFrame, seconds_per_block: float) -> DataFrame:
    """Metadata computed from prints: their number, and the time of the last third point."""
    return prints.groupBy("resource_id").agg(F.count(F.lit(1)).alias("num_fingerprints"), (F.max("t3") * F.lit(seconds_per_block)).alias("duration"))


def statistics(metadata: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row: resources, total duration and prints, average, most and fewest prints a second with their paths (a least path wins ties; resources without a positive rate don't compete), postings.

    Null durations and counts don't add; a resource without duration has no rate.
    """
    x = metadata.withColumn("rate", F.try_divide(F.col("num_fingerprints").cast("double"), F.when(F.col("duration") > 0, F.col("duration"))))
    rated = F.when(F.col("rate") > 0, F.col("rate"))
    order = lambda sign: F.min(F.when(rated.isNotNull(), F.struct((sign * F.col("rate")).alias("k"), F.col("path").alias("p"))))
    out = x.agg(
        F.count(F.lit(1)).alias("resources"), F.sum("duration").alias("total_duration"), F.sum("num_fingerprints").alias("total_prints"),
        F.try_divide(F.sum("num_fingerprints").cast("double"), F.sum("duration")).alias("avg_prints_per_second"),
        F.max(rated).alias("max_prints_per_second"), F.min(rated).alias("min_prints_per_second"), order(-1).alias("_hi"), order(1).alias("_lo"),
    ).select("*", F.col("_hi.p").alias("max_path"), F.col("_lo.p").alias("min_path")).drop("_hi", "_lo")
    if postings is not None:
        out = out.withColumn("postings", postings.agg(F.count(F.lit(1))).scalar())
    return out


def prints_per_second(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("prints_per_second", F.try_divide(F.col("num_fingerprints").cast("double"), F.when(F.col("duration") > 0, F.col("duration"))))


def metadata_text(metadata: DataFrame) -> DataFrame:
    """``resource_id, line``: the shown form of a resource's metadata."""
    return metadata.select("resource_id", F.format_string("%d ; %s ; %.3f ; %d", "resource_id", "path", "duration", "num_fingerprints").alias("line"))


class MemoryIndex:
    """The index in executor memory for one session, with bag semantics: each insert appends, repeated postings stay. Lost blocks are computed again from the inputs."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def clear(self) -> None:
        for df in (getattr(self, "postings", None), getattr(self, "metadata", None)):
            if df is not None:
                df.unpersist()
        self.postings = self.spark.createDataFrame([], "hash bigint, resource_id int, t1 int, f1 int")
        self.metadata = self.spark.createDataFrame([], "resource_id int, path string, duration double, num_fingerprints bigint")

    def store(self, postings: DataFrame, metadata: DataFrame) -> None:
        self.postings = insert_bag(self.postings, postings).cache()
        self.metadata = upsert_metadata(self.metadata, metadata).cache()

    def load(self, postings: DataFrame, metadata: DataFrame) -> None:
        """As :meth:`StoredIndex.load`."""
        fresh = not_stored(metadata, self.metadata).cache()
        self.store(stored(postings, fresh), fresh)

    def delete(self, postings: DataFrame, ids: DataFrame) -> None:
        self.postings, self.metadata = delete(self.postings, postings).cache(), delete_metadata(self.metadata, ids).cache()

    def statistics(self) -> DataFrame:
        return statistics(self.metadata, self.postings)


class Versioned:
    """Tables under one path as Parquet segments and a numbered manifest that names the ones that count; a version takes effect by one rename, so a write that fails half-way changes nothing. One writer at a time."""

    _SCHEMAS: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str) -> tuple:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self) -> dict:
        """The live segments of each table - of postings, of each part - and ``number``, that of the version."""
        fs, folder = self._fs("manifest")
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []
        if not numbers:
            return {"number": 0, **{name: {} if "part" in kinds else [] for name, kinds in self._SCHEMAS.items()}}
        stream = fs.open(self._fs(f"manifest/{numbers[-1]}")[1])
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {**json.loads(text), "number": numbers[-1]}

    def _commit(self, manifest: dict) -> None:
        fs, draft = self._fs(f"manifest/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"manifest/{manifest['number'] + 1}")[1]):
            raise RuntimeError(f"another writer committed version {manifest['number'] + 1}")

    def _read(self, name: str, live: Column | None) -> DataFrame:
        fs, where = self._fs(name)
        if live is None or not fs.exists(where):
            return self.spark.createDataFrame([], self._SCHEMAS[name])
        return self.spark.read.schema(self._SCHEMAS[name]).parquet(f"{self.path}/{name}").where(live)

    def _segments(self, name: str, manifest: dict) -> DataFrame:
        return self._read(name, F.col("seg").isin(manifest[name]) if manifest[name] else None).drop("seg")

    def _segment(self, name: str, df: DataFrame) -> str:
        seg = uuid.uuid4().hex
        df.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("seg").parquet(f"{self.path}/{name}")
        return seg

    def clear(self) -> None:
        for name in ("manifest", *self._SCHEMAS):
            fs, where = self._fs(name)
            fs.delete(where, True)


class StoredIndex(Versioned):
    """The index as Parquet folders under one path: append as a set, delete, load, clear.

    Postings lie in ``postings/part=P/seg=S``. An insert rewrites nothing, a deletion rewrites the parts it touches.
    """

    _SCHEMAS = {"postings": "hash bigint, resource_id int, t1 int, f1 int, part int, seg string", "metadata": "resource_id int, path string, duration double, num_fingerprints bigint, seg string"}

    def _postings(self, manifest: dict) -> DataFrame:
        # segments that hold the same parts are named together; both columns are folders, so this lists and reads live ones only
        groups: dict[tuple, list[int]] = {}
        for part, segments in manifest["postings"].items():
            groups.setdefault(tuple(segments), []).append(int(part))
        live = None
        for segments, parts in groups.items():
            one = F.col("part").isin(parts) & F.col("seg").isin(list(segments))
            live = one if live is None else live | one
        return self._read("postings", live)

    @property
    def postings(self) -> DataFrame:
        """With ``part``, by which lookups choose what to read."""
        return self._postings(self._manifest()).select(*POSTING, "part")

    @property
    def metadata(self) -> DataFrame:
        return self._segments("metadata", self._manifest())

    def _append(self, df: DataFrame) -> tuple[str, list[int]]:
        """Write postings as a new segment; its name and parts. The ranges are of (hash, resource, time), so a hot hash is cut like any other range."""
        seg = uuid.uuid4().hex
        rows = Written(df.select(*POSTING, part_of(F.col("hash")).alias("part")), "segment")
        if rows.rows:
            spread = rows.df.repartitionByRange(shuffle_partitions(self.spark), "part", *POSTING).sortWithinPartitions("part", *POSTING)
            spread.withColumn("seg", F.lit(seg)).write.mode("append").partitionBy("part", "seg").parquet(f"{self.path}/postings")
        parts = [r[0] for r in rows.df.select("part").distinct().collect()]
        rows.drop()
        return seg, parts

    def store(self, postings: DataFrame, metadata: DataFrame) -> None:
        """Add postings as a set and put their metadata. Only postings of the fresh resources, in the parts of the fresh hashes, are compared; a null hash or resource is no posting."""
        manifest = self._manifest()
        fresh = Written(postings.where("hash IS NOT NULL AND resource_id IS NOT NULL").select(*POSTING).dropDuplicates(list(POSTING)), "fresh")
        ids = Written(fresh.df.select("resource_id").distinct(), "ids")
        held = only_parts(self._postings(manifest), fresh, "hash").join(small(ids.df, ids.rows), "resource_id", "left_semi")
        gone = held.select(*(F.col(c).alias(f"_g_{c}") for c in POSTING))
        rows = fresh.df
        seg, parts = self._append(rows.join(gone, _both(rows, gone), "left_anti"))
        for p in parts:
            manifest["postings"].setdefault(str(p), []).append(seg)
        manifest["metadata"] = [self._segment("metadata", upsert_metadata(self._segments("metadata", manifest), metadata))]
        self._commit(manifest)
        fresh.drop()
        ids.drop()

    def delete(self, postings: DataFrame, ids: DataFrame) -> None:
        """Remove exactly the given postings, and the metadata of ``ids``. Only the parts they fall into are written anew."""
        manifest = self._manifest()
        gone = Written(postings.where("hash IS NOT NULL").select(*POSTING).distinct(), "gone")
        touched = only_parts(self._postings(manifest), gone, "hash")
        parts = [r[0] for r in touched.select("part").distinct().collect()]
        seg, left = self._append(delete(touched, gone.df))
        for p in parts:
            manifest["postings"].pop(str(p), None)
        for p in left:
            manifest["postings"][str(p)] = [seg]
        manifest["metadata"] = [self._segment("metadata", delete_metadata(self._segments("metadata", manifest), ids))]
        self._commit(manifest)
        gone.drop()

    def load(self, postings: DataFrame, metadata: DataFrame) -> None:
        """Bulk load of cached prints: resources that have metadata in the cache and none here yet."""
        fresh = Written(not_stored(metadata, self.metadata), "fresh")
        self.store(stored(postings, fresh.df), fresh.df)

    def compact(self) -> None:
        """Write each part as one segment and delete all folders that no longer count. Not while others read."""
        manifest = self._manifest()
        seg, parts = self._append(self._postings(manifest))
        kept = {"number": manifest["number"], "postings": {str(p): [seg] for p in parts}, "metadata": manifest["metadata"]}
        self._commit(kept)
        for name, live in (("postings/part=*", {seg}), ("metadata", set(kept["metadata"]))):
            fs, where = self._fs(f"{name}/seg=*")
            for f in fs.globStatus(where) or []:
                if f.getPath().getName().removeprefix("seg=") not in live:
                    fs.delete(f.getPath(), True)

    def statistics(self) -> DataFrame:
        return statistics(self.metadata, self.postings)


class HistogramStore(Versioned):
    """Pitch-class histograms with the path of their resource. One a resource: storing it again replaces it."""

    _SCHEMAS = {"histograms": "resource_id int, path string, bins array<bigint>, seg string"}

    @property
    def histograms(self) -> DataFrame:
        return self._segments("histograms", self._manifest())

    def store(self, fresh: DataFrame) -> None:
        manifest = self._manifest()
        kept = Written(fresh.select("resource_id", "path", "bins").dropDuplicates(["resource_id"]), "histograms")
        old = self._segments("histograms", manifest)
        if old.join(kept.df.select("resource_id"), "resource_id", "left_semi").isEmpty():
            manifest["histograms"].append(self._segment("histograms", kept.df))
        else:
            manifest["histograms"] = [self._segment("histograms", old.join(kept.df.select("resource_id"), "resource_id", "left_anti").unionByName(kept.df))]
        self._commit(manifest)
        kept.drop()
