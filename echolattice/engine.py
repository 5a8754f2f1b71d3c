"""The engine as a user sees it: store, query, monitor, delete, compare and inspect recordings. Each call is one plan over all its files.

What differs between ways of matching is a :class:`Strategy`; :func:`strategy` adds one under a name, and the setting ``strategy`` chooses it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.config import EngineConfig
from echolattice.functions.murmur import file_hash
from echolattice.functions.names import identifier, window_label
from echolattice.operators import dedup, index, match, monitor, pch
from echolattice.operators.fingerprints import fingerprints
from echolattice.runtime import Written
from echolattice.sources import audio, cachefiles


class Strategy(Protocol):
    """One way of indexing and matching. ``files`` has ``resource_id, path, content`` of admitted files, ``avoid`` ``query_id, resource_id``."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig): ...

    def store(self, files: DataFrame) -> DataFrame: ...

    def query(self, files: DataFrame, most: int, avoid: DataFrame | None) -> DataFrame: ...

    def monitor(self, files: DataFrame, most: int, avoid_self: bool) -> DataFrame: ...

    def delete(self, files: DataFrame) -> None: ...

    def stored(self, files: DataFrame) -> DataFrame: ...

    def metadata(self, files: DataFrame) -> DataFrame: ...

    def statistics(self) -> DataFrame: ...

    def load(self, prints: str, metadata: str) -> None: ...

    def clear(self) -> None: ...

    def print(self, files: DataFrame, points: bool, matrix: bool) -> DataFrame: ...


STRATEGIES: dict[str, type] = {}


def described(files: DataFrame, decoder: str) -> Written:
    """``resource_id, path, duration`` of files, in one pass over their content; a null duration means that it can't be decoded."""
    return Written(files.select("resource_id", "path", audio.seconds_of(F.col("content"), decoder).alias("duration")), "files")


def chosen(files: DataFrame, described_: DataFrame, rows: int) -> DataFrame:
    """``resource_id, path, content`` of the ``described_`` ones among ``files``: their names go to the content, which is read again but never shuffled (up to MOST_BROADCAST_ROWS of them)."""
    return files.select("path", "content").join(index.small(described_.select("path", "resource_id"), rows), "path").select("resource_id", "path", "content")


def strategy(*names: str) -> Callable[[type], type]:
    """Registers a :class:`Strategy` under the given names."""

    def add(kind: type) -> type:
        STRATEGIES.update(dict.fromkeys(names, kind))
        return kind

    return add


@strategy("fft", "constant_q")
class Fingerprints:
    """Event points, fingerprints and the inverted index, for either of the two transforms."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig):
        self.spark, self.config = spark, config
        self.index = index.MemoryIndex(spark) if config.storage == "memory" else index.StoredIndex(spark, f"{path}/{config.strategy.lower()}")

    def event_points(self, files: DataFrame) -> DataFrame:
        return audio.event_points_of(files, self.config.algorithm, self.config.decoder)

    def prints(self, files: DataFrame) -> DataFrame:
        return fingerprints(self.event_points(files), self.config.algorithm)

    def postings(self, files: DataFrame) -> DataFrame:
        return self.prints(files).select("hash", "resource_id", "t1", "f1")

    def stored(self, files: DataFrame) -> DataFrame:
        """Those that are indexed already."""
        return index.stored(files, self.index.metadata)

    def store(self, files: DataFrame) -> DataFrame:
        """``resource_id, path, duration, num_fingerprints`` of what is added; content that can't be decoded is not, so it can be stored once it can."""
        seen = described(files, self.config.decoder)
        fresh = seen.df.where("duration IS NOT NULL")
        if self.config.check_duplicates:
            fresh = index.not_stored(fresh, self.index.metadata)
        fresh = Written(fresh, "fresh")
        kept = Written(self.prints(chosen(files, fresh.df, fresh.rows)).select("hash", "resource_id", "t1", "f1", "t3"), "prints")
        counts = kept.df.groupBy("resource_id").agg(F.count(F.lit(1)).alias("num_fingerprints"))
        meta = fresh.df.join(counts, "resource_id", "left").select("resource_id", "path", "duration", F.coalesce("num_fingerprints", F.lit(0).cast("bigint")).alias("num_fingerprints"))
        meta = Written(meta, "metadata")
        self.index.store(kept.df, meta.df)
        if self.config.cache_folder:  # the same stored table also feeds the text caches
            cachefiles.write_prints(kept.df, f"{self.config.cache_folder}/prints")
            cachefiles.write_metadata(meta.df, f"{self.config.cache_folder}/metadata")
        if self.config.storage != "memory":
            kept.drop()
        return meta.df

    def query(self, files: DataFrame, most: int, avoid: DataFrame | None) -> DataFrame:
        seen = described(files, self.config.decoder)
        asked = seen.df.select(F.col("resource_id").alias("query_id"), F.col("path").alias("query_path"))
        q = self.postings(chosen(files, seen.df, seen.rows)).select(F.col("resource_id").alias("query_id"), "hash", "t1", "f1")
        found = match.query(q, self.index.postings, self.config.algorithm, most, avoid)
        return match.with_metadata(match.with_empty(asked, found), self.index.metadata)

    def monitor(self, files: DataFrame, most: int, avoid_self: bool) -> DataFrame:
        c, seen = self.config, described(files, self.config.decoder)
        found = monitor.monitor(self.postings(chosen(files, seen.df, seen.rows)), self.index.postings, seen.df, c.algorithm, c.monitor_window, c.monitor_overlap, most, avoid_self, empty=True)
        found = found.join(seen.df.select("resource_id", "path"), "resource_id").withColumn("query_path", window_label(F.col("path"), F.col("start"), F.col("stop"))).drop("label")
        return match.with_metadata(found, self.index.metadata)

    def delete(self, files: DataFrame) -> None:
        self.index.delete(self.postings(files), files.select("resource_id"))

    def metadata(self, files: DataFrame) -> DataFrame:
        """``resource_id, line``; the line says so where a file isn't indexed."""
        found = index.lookup(self.index.metadata, files.select("resource_id"))
        return found.join(index.metadata_text(found.where("path IS NOT NULL")), "resource_id", "left").select("resource_id", F.coalesce("line", F.lit("is not indexed")).alias("line"))

    def statistics(self) -> DataFrame:
        return self.index.statistics()

    def load(self, prints: str, metadata: str) -> None:
        """Bulk load of cached prints: resources that have metadata beside them and are not stored yet."""
        self.index.load(cachefiles.read_prints(self.spark, prints), cachefiles.read_metadata(self.spark, metadata))

    def clear(self) -> None:
        self.index.clear()

    def print(self, files: DataFrame, points: bool, matrix: bool) -> DataFrame:
        c = self.config.algorithm
        if points:
            return cachefiles.event_point_table(self.event_points(files), c, match.bin_hertz(F.col("f"), c))
        if matrix:
            return cachefiles.dense_matrix(self.prints(files), audio.bands(c))
        return self.prints(files).select(F.concat_ws(" ", "hash", "resource_id", "t1", "f1").alias("line"))


@strategy("pch", "pitch_class_histogram")
class Histograms:
    """Pitch-class histograms, matched over all circular shifts."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig):
        self.spark, self.config = spark, config
        self.index = index.HistogramStore(spark, f"{path}/pch")

    def histograms(self, files: DataFrame) -> DataFrame:
        """``resource_id, bins`` of each file that can be decoded; one without a pitched frame has empty bins."""
        p = self.config.pitch
        blocks = audio.pcm(files, p.sample_rate, p.block_size - p.block_overlap, p.block_overlap, decoder=self.config.decoder)
        found = pch.dense(pch.pitch_class_histogram(audio.pitch_track(blocks, p)), p.bins)
        known = audio.durations(files, self.config.decoder).where("duration IS NOT NULL").select("resource_id")
        return known.join(found, "resource_id", "left").withColumn("bins", F.coalesce("bins", F.array_repeat(F.lit(0).cast("bigint"), p.bins)))

    def stored(self, files: DataFrame) -> DataFrame:
        return index.stored(files, self.index.histograms)

    def store(self, files: DataFrame) -> DataFrame:
        """``resource_id, path`` of what is added; a resource that is stored already is skipped, or replaced if duplicates aren't checked."""
        if self.config.check_duplicates:
            files = index.not_stored(files, self.index.histograms)
        kept = Written(self.histograms(files).join(files.select("resource_id", "path"), "resource_id"), "histograms")
        self.index.store(kept.df)
        return kept.df.select("resource_id", "path")

    def query(self, files: DataFrame, most: int, avoid: DataFrame | None) -> DataFrame:
        """The printed columns and ``match, shift, ratio``: the score is the match in whole percent, the frequency factor the shift's ratio. There are no times."""
        asked = files.select(F.col("resource_id").alias("query_id"), F.col("path").alias("query_path"))
        stored = self.index.histograms
        found = pch.shift_matches(self.histograms(files), stored)
        if avoid is not None:
            found = found.join(avoid.select("query_id", F.col("resource_id").alias("ref_id")), ["query_id", "ref_id"], "left_anti")
        none = {c: F.lit(-1.0) for c in ("query_start", "query_stop", "ref_start", "ref_stop", "time_factor")}
        found = pch.ranked(found, most).withColumns({**none, "score": F.floor(F.col("match") * 100).cast("bigint"), "freq_factor": F.col("ratio") / 100, "coverage": F.lit(0.0)})
        return match.with_metadata(match.with_empty(asked, found), stored)

    def monitor(self, files: DataFrame, most: int, avoid_self: bool) -> DataFrame:
        raise NotImplementedError("histograms describe whole recordings and can't be monitored")

    def delete(self, files: DataFrame) -> None:
        raise NotImplementedError("histograms can't be deleted one by one; clear removes all")

    def metadata(self, files: DataFrame) -> DataFrame:
        line = F.coalesce(F.format_string("%d ; %s", "resource_id", "path"), F.lit("is not indexed"))
        return index.lookup(self.index.histograms, files.select("resource_id")).select("resource_id", F.when(F.col("path").isNull(), "is not indexed").otherwise(line).alias("line"))

    def statistics(self) -> DataFrame:
        return self.index.histograms.agg(F.count(F.lit(1)).alias("resources"))

    def load(self, prints: str, metadata: str) -> None:
        raise NotImplementedError("there is no cache of histograms")

    def clear(self) -> None:
        self.index.clear()

    def print(self, files: DataFrame, points: bool, matrix: bool) -> DataFrame:
        return self.histograms(files).select(F.concat_ws(" ", "resource_id", F.concat_ws(" ", F.col("bins").cast("array<string>"))).alias("line"))


class Engine:
    """Recordings are WAV files, or anything that the setting ``decoder`` turns into WAV; ``path`` is the folder of the index, reachable by all executors."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.strategy: Strategy = STRATEGIES[self.config.strategy.lower()](spark, path.rstrip("/"), self.config)

    def _listed(self, paths: list[str]) -> DataFrame:
        return self.spark.read.format("binaryFile").load(audio.listed(self.spark, paths))

    def _refused(self) -> Column:
        return F.when(F.floor(F.col("length") / audio.MAX_BYTES) >= self.config.max_file_size_mb, "larger than the setting allows").when(F.col("length") > audio.MOST_CONTENT, "larger than 2 GiB")

    def files(self, paths: list[str]) -> DataFrame:
        """``resource_id, path, content`` of the admitted files among the arguments (globs and ``.txt`` lists included)."""
        x = self._listed(paths).where(self._refused().isNull())
        return x.select(identifier(F.col("path"), file_hash("content")).alias("resource_id"), "path", "content")

    def rejected(self, paths: list[str]) -> DataFrame:
        """``path, reason`` of the files that aren't admitted or can't be decoded. Empty files are not listed by the scan."""
        x = self._listed(paths)
        refused = x.select("path", self._refused().alias("reason"), "length")
        bad = self.files(paths).select("path", audio.problems(F.col("content"), self.config.decoder).alias("reason"))
        return refused.select("path", "reason").where("reason IS NOT NULL").unionByName(bad.where("reason IS NOT NULL"))

    # --- commands

    def store(self, paths: list[str]) -> DataFrame:
        """Index files that aren't stored yet; ``resource_id, path`` and more of those."""
        return self.strategy.store(self.files(paths))

    def query(self, paths: list[str], most: int | None = None, avoid: DataFrame | None = None) -> DataFrame:
        """The printed columns of the results of each file; files without a match have one empty row."""
        return self.strategy.query(self.files(paths), self.config.number_of_results if most is None else most, avoid)

    def monitor(self, paths: list[str], most: int | None = None, avoid_self: bool = False) -> DataFrame:
        """The same for each window of the files; ``query_path`` names the window."""
        return self.strategy.monitor(self.files(paths), self.config.number_of_results if most is None else most, avoid_self)

    def delete(self, paths: list[str]) -> None:
        """Remove exactly the prints and the metadata of the given files."""
        self.strategy.delete(self.files(paths))

    def deduplicate(self, paths: list[str], by_content: bool = False) -> DataFrame:
        if by_content:
            x = self.files(paths)
            return dedup.content_members(x.select("path", "content"), "path", "content")
        self.store(paths)
        return self.monitor(paths, most=10, avoid_self=True).where("ref_id IS NOT NULL")

    def same(self, first: str, second: str) -> DataFrame:
        """``first, second, percent``: two files, told apart by the argument they were given as, whatever their names and contents."""
        pair = self.files([first]).withColumn("resource_id", F.lit(1)).unionByName(self.files([second]).withColumn("resource_id", F.lit(2)))
        asked = self.spark.range(1).select(F.lit(1).alias("first_id"), F.lit(2).alias("second_id"))
        engine = Fingerprints(self.spark, "", self.config) if isinstance(self.strategy, Histograms) else self.strategy
        found = dedup.shared_percent(asked, engine.postings(pair), self.config.algorithm)
        return found.select(F.lit(first).alias("first"), F.lit(second).alias("second"), "percent")

    def stored(self, paths: list[str]) -> DataFrame:
        """``resource_id, path`` of the given files that are indexed."""
        return self.strategy.stored(self.files(paths).select("resource_id", "path"))

    def stats(self) -> DataFrame:
        return self.strategy.statistics()

    def metadata(self, paths: list[str]) -> DataFrame:
        return self.strategy.metadata(self.files(paths))

    def resolve(self, paths: list[str]) -> DataFrame:
        return self.files(paths).select("path", "resource_id")

    def print(self, paths: list[str], points: bool = False, matrix: bool = False) -> DataFrame:
        """Event points with seconds and hertz, a dense matrix of the prints' points, or the prints as text lines."""
        return self.strategy.print(self.files(paths), points, matrix)

    def load(self, prints: str, metadata: str) -> None:
        self.strategy.load(prints, metadata)

    def clear(self) -> None:
        self.strategy.clear()
