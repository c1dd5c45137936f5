"""Choosing pairs: names, blacklists, coverage, and the selection with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hexadecimal digits of a path's hash that name its part of a digest: 4,096 parts.
PART_DIGITS = 3


def validate_pairlist(df: DataFrame, spot: bool = True) -> DataFrame:
    """Error code of each pair (order, pair), NULL if it is sound: name, spot (a settle currency in a spot list), duplicate."""
    p = F.col("pair")
    copies = F.count("*").over(Window.partitionBy("pair"))
    code = F.when(p.isNull() | (F.trim(p) != p) | ~p.rlike(r"^[^/\s]+/[^/\s]+$"), "name").when(F.lit(spot) & p.contains(":"), "spot").when(copies > 1, "duplicate")
    return df.withColumn("error", code)


def filter_blacklist(pairs: DataFrame, patterns: list[str]) -> DataFrame:
    """Pairs that no pattern matches in full."""
    if not patterns:
        return pairs
    return pairs.where(~F.col("pair").rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"))


def blacklisted_pairs(candidates: DataFrame, accepted: DataFrame) -> DataFrame:
    """Candidates that were not accepted, sorted."""
    return candidates.select("pair").subtract(accepted.select("pair")).orderBy("pair")


def select_universe(candidates: DataFrame, gaps: DataFrame, quality: DataFrame, n: int) -> DataFrame:
    """Each candidate (order, pair) with its reasons, joined by commas, and whether it is among the first n without any.

    gaps: pair, start_missing, end_missing; quality: pair, duplicates, reversals, gaps.
    """
    bad = candidates.join(gaps.select("pair", "start_missing", "end_missing"), "pair", "left").join(quality.select("pair", "duplicates", "reversals", "gaps"), "pair", "left")
    reason = lambda cond, name: F.when(F.coalesce(cond, F.lit(True)), F.lit(name))  # noqa: E731  what is not known counts against a pair
    reasons = F.concat_ws(",", reason(F.col("start_missing"), "start"), reason(F.col("end_missing"), "end"), reason(F.col("duplicates") > 0, "duplicates"), reason(F.col("reversals") > 0, "reversals"), reason(F.col("gaps") > 0, "gaps"))
    listed = bad.select("order", "pair", reasons.alias("reasons"))
    rank = F.sum((F.col("reasons") == "").cast("int")).over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    return listed.withColumn("_r", rank).withColumn("selected", (F.col("reasons") == "") & (F.col("_r") <= n)).drop("_r")


def selection_report(selection: DataFrame, blacklisted: DataFrame, quality: DataFrame | None = None, required: int | None = None) -> DataFrame:
    """One row: pairs selected, rejected and blacklisted, as sorted text; candidates and required as numbers; quality as JSON, one object a candidate pair (pair, duplicates, reversals, gaps), sorted."""
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("pair")))), ",")
    out = selection.agg(names(F.col("selected")).alias("selected"), names(F.col("reasons") != "").alias("rejected"), F.count("*").alias("candidates"))
    out = out.crossJoin(blacklisted.agg(F.array_join(F.array_sort(F.collect_list("pair")), ",").alias("blacklisted"))).withColumn("required", F.lit(required).cast("int"))  # one row each
    if quality is None:
        return out.withColumn("quality", F.lit("[]"))
    row = F.struct("pair", "duplicates", "reversals", "gaps")
    known = quality.join(selection.select("pair"), "pair", "left_semi").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("quality"))
    return out.crossJoin(known)


def feature_union(rules: DataFrame) -> DataFrame:
    """Distinct features that rule sets (rule, features) name."""
    return rules.select(F.explode("features").alias("feature")).distinct()


def verify_inventory(sealed: DataFrame, current: DataFrame) -> DataFrame:
    """Files whose state changed: path and reason. Inventories: path, bytes, sha256, rows, first_ts, last_ts."""
    names = ["bytes", "sha256", "rows", "first_ts", "last_ts"]
    a = sealed.select("path", *[F.col(c).alias(f"a_{c}") for c in names])
    b = current.select("path", *[F.col(c).alias(f"b_{c}") for c in names])
    off = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    reason = F.when(F.col("b_bytes").isNull(), "missing").when(F.col("a_bytes").isNull(), "unsealed").when(off("bytes"), "size").when(off("sha256"), "hash").when(off("rows") | off("first_ts") | off("last_ts"), "coverage")
    return a.join(b, "path", "full_outer").withColumn("reason", reason).where("reason is not null").select("path", "reason")


def dataset_digest(inventory: DataFrame) -> DataFrame:
    """One row: files, bytes, and a digest over (path, bytes, hash, coverage).

    Lines are dealt into 16 ** PART_DIGITS parts by a hash of the path and sorted there; the digest is SHA-256 over the digests of the parts in order, so no task holds all lines.
    """
    line = F.concat_ws("|", "path", F.col("bytes").cast("string"), "sha256", F.coalesce(F.col("rows").cast("string"), F.lit("-")), F.coalesce(F.col("first_ts").cast("string"), F.lit("-")), F.coalesce(F.col("last_ts").cast("string"), F.lit("-")))
    part = F.substring(F.sha2(F.coalesce("path", F.lit("")), 256), 1, PART_DIGITS)
    lines = inventory.select(part.alias("part"), "bytes", line.alias("line")).groupBy("part")
    parts = lines.agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "d")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sum("b").cast("long").alias("bytes"), F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["part"], F.lit(":"), x["d"])), "\n"), 256).alias("digest"))
