"""The queries of the training-data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolattice.llm import components, frequent, mixture, oracle, reading, tokens, topn
from echolattice.sources.tables import table, trimmed


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best matches of each query path."""
    lines = table(spark, folder, "result_lines")
    lines = lines.where("query_path IS NOT NULL AND ref_path IS NOT NULL AND match_score IS NOT NULL").withColumns({"query_path": trimmed("query_path"), "ref_path": trimmed("ref_path")})
    same = [c for c in lines.columns if c not in ("line_id", "loaded_at")]
    return topn.top_n(lines, "query_path", "match_score", ["ref_id"], "line_id", 5, same).select("query_path", "line_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes in at least 1 of 1,000 rows with a hash."""
    return frequent.frequent(table(spark, folder, "postings"), "hash", 0.001).select("hash")


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same hashes with their exact and approximate counts."""
    return frequent.frequent(table(spark, folder, "postings"), "hash", 0.001)


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The same hashes with their exact counts, and whether the approximate ones keep their bounds: never too low, and too high by at most what is stated and by 1 of 4,000 rows."""
    found = frequent.frequent(table(spark, folder, "postings"), "hash", 0.001)
    rows = table(spark, folder, "postings").agg(F.count("hash")).scalar()
    fits = (F.col("n_rows") <= F.col("n_estimated")) & (F.col("n_estimated") - F.col("n_over") <= F.col("n_rows")) & (F.col("n_over") * 4000 <= rows)
    return found.select("hash", "n_rows", fits.alias("within"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each matched file with the smallest path of its group."""
    lines = table(spark, folder, "dedup_lines").select(trimmed("query_path").alias("x"), trimmed("ref_path").alias("y"))
    return components.groups(lines, "x", "y").select(F.col("item").alias("item_path"), F.col("group_item").alias("group_path"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each notebook."""
    return tokens.token_ids(table(spark, folder, "documents"), ["doc_id"], "text")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.sized(table(spark, folder, "documents"), "doc_id", "source", "text")


def _beyond(sized: DataFrame) -> float:
    return 1.5 * (sized.agg(F.sum("n_tokens")).first()[0] or 0)


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The notebooks of the mixture, how often each is used, and the shares reached."""
    return mixture.mix(_sized(spark, folder), table(spark, folder, "mix_targets"), "doc_id", "source", "n_tokens")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of each source."""
    return mixture.shares(p8_mixture(spark, folder), table(spark, folder, "mix_targets"), "source", "n_tokens")


def p8_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The shares for a mixture one and a half times as large as all notebooks, for which sources have to be used up to their caps."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixture.shares(mixture.mix(sized, targets, "doc_id", "source", "n_tokens", total=_beyond(sized)), targets, "source", "n_tokens")


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For the mixture of all shares and the one beyond the caps: whether what is promised of them holds, a row for each source."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    out = []
    for name, total in (("shares", None), ("capped", _beyond(sized))):
        mixed = mixture.mix(sized, targets, "doc_id", "source", "n_tokens", total=total)
        out.append(mixture.kept(mixed, sized, targets, "doc_id", "source", "n_tokens", total).select(F.lit(name).alias("mixture"), "*"))
    return out[0].unionByName(out[1])


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated reading level of each notebook with prose."""
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_levels"), "doc_id", "text", "reading_level")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks whose prose is demanding."""
    return p9_levels(spark, folder).where("level = 3").select("doc_id")


def p9_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on the judgements of even ids only: for each level how many judgements of odd ids there are, and whether three of four agree with the estimate (some judgements are wrong)."""
    judged = table(spark, folder, "reading_levels").where("reading_level IS NOT NULL")
    levels = reading.reading_levels(table(spark, folder, "documents"), judged.where("doc_id % 2 = 0"), "doc_id", "text", "reading_level")
    both = judged.where("doc_id % 2 = 1").join(levels, "doc_id", "left").groupBy("reading_level")
    return both.agg(F.count(F.lit(1)).alias("judged"), (F.count_if(F.col("level") == F.col("reading_level")) * 4 >= F.count(F.lit(1)) * 3).alias("agree"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_counts": p2_counts, "p2_bounds": p2_bounds, "p5_found": p5_found, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_capped": p8_capped, "p8_kept": p8_kept, "p9_found": p9_found, "p9_levels": p9_levels, "p9_held_out": p9_held_out}
ORACLE = oracle.ORACLE
