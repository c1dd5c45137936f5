"""Statistics of run records: lane, run_id, status, wall_time_seconds, peak_rss_bytes, result_sha256, updated_at, arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The release policy, and the phases of a profile.
MIN_PAIRS, MIN_DAYS, MIN_SPEEDUP, MAX_SPREAD = 80, 1825, 10.0, 0.05
PHASES = ("indicators", "callbacks", "trade_scans", "event_simulation")
#: Columns of a run that keep their first value on an upsert.
IMMUTABLE = ("lane", "result_sha256")


def run_stats(runs: DataFrame) -> DataFrame:
    """Wall time and peak memory of completed runs by lane; exact medians."""
    ok = runs.where("status = 'completed'")
    w, p = F.col("wall_time_seconds"), F.col("peak_rss_bytes")
    return ok.groupBy("lane").agg(F.count("*").alias("runs"), F.min(w).alias("min_wall"), F.median(w).alias("median_wall"), F.max(w).alias("max_wall"), F.avg(F.round(w, 6).cast("decimal(20,6)")).cast("double").alias("mean_wall"), F.min(p).alias("min_peak"), F.max(p).alias("max_peak"))


def relative_spread(runs: DataFrame) -> DataFrame:
    """(max - min) / median of wall time by lane, 0 if the median is 0."""
    s = run_stats(runs)
    return s.select("lane", F.when(F.col("median_wall") == 0, 0.0).otherwise((F.col("max_wall") - F.col("min_wall")) / F.col("median_wall")).alias("spread"))


def determinism_check(runs: DataFrame) -> DataFrame:
    """Whether all runs of a lane have one result hash, and none is missing."""
    return runs.groupBy("lane").agg(F.count_distinct("result_sha256").alias("hashes"), ((F.count_distinct("result_sha256") == 1) & F.bool_and(F.col("result_sha256").isNotNull())).alias("deterministic"))


def scope_gate(runs: DataFrame) -> DataFrame:
    """Whether a run covers enough pairs and days to be representative. Needs pair_count and days."""
    return runs.withColumn("representative", (F.col("pair_count") >= MIN_PAIRS) & (F.col("days") >= MIN_DAYS))


def speedup_gate(runs: DataFrame, reference: str, candidate: str, memory_limit: float) -> DataFrame:
    """One row: median ratio of two lanes and the verdict on speed, memory and determinism."""
    s, d = run_stats(runs), determinism_check(runs)
    both = s.join(d, "lane").where(F.col("lane").isin(reference, candidate))
    of = lambda lane, c: F.max(F.when(F.col("lane") == lane, F.col(c)))
    out = both.agg((of(reference, "median_wall") / of(candidate, "median_wall")).alias("speedup"), (of(candidate, "max_peak") <= memory_limit).alias("memory_ok"), F.bool_and("deterministic").alias("deterministic"))
    fast = F.coalesce(F.col("speedup") >= MIN_SPEEDUP, F.lit(False))
    return out.withColumn("fast_enough", fast).withColumn("passed", fast & F.coalesce("memory_ok", F.lit(False)) & F.col("deterministic"))


def phase_profile(events: DataFrame) -> DataFrame:
    """Calls, total and longest seconds of every known phase; phases without events have none."""
    known = events.sparkSession.createDataFrame([(p,) for p in PHASES], "phase string")
    sums = events.groupBy("phase").agg(F.count("*").alias("calls"), F.sum(F.round("wall_time_seconds", 6).cast("decimal(20,6)")).cast("double").alias("total"), F.max("wall_time_seconds").alias("longest"))
    out = known.join(sums, "phase", "left")
    return out.withColumn("missing", F.col("calls").isNull()).withColumns({"calls": F.coalesce("calls", F.lit(0).cast("long")), "total": F.coalesce("total", F.lit(0.0)), "longest": F.coalesce("longest", F.lit(0.0))})


def batch_efficiency(jobs: DataFrame, wall: float, slots: int) -> DataFrame:
    """One row: summed seconds, effective parallelism, efficiency over slots, and whether all jobs completed."""
    total = F.sum(F.round("wall_time_seconds", 6).cast("decimal(20,6)")).cast("double")
    out = jobs.agg(total.alias("job_seconds"), F.bool_and(F.col("status") == "completed").alias("all_complete"))
    return out.withColumn("parallelism", F.col("job_seconds") / wall).withColumn("efficiency", F.col("job_seconds") / wall / slots)


def outcome_samples(events: DataFrame, keys: list[str], n: int = 3, order: str = "arrival") -> DataFrame:
    """Count of each outcome signature, with its first n samples (sample_1 ..).

    The first ones are kept by a running limit in each partial result, so a frequent signature is not gathered in one place.
    """
    counts = events.groupBy(*keys).agg(F.count("*").alias("outcomes"))
    spread = events.withColumn("_s", F.pmod(F.xxhash64(order), F.lit(64)))
    few = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")
    kept = few(few(spread, [*keys, "_s"]), keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(order)), ",").alias("samples"))
    return counts.join(kept, keys)


def pair_footprint(inventory: DataFrame) -> DataFrame:
    """Bytes of each pair, and whether it is the largest (on a tie the greater name)."""
    sums = inventory.groupBy("pair").agg(F.sum("bytes").cast("long").alias("bytes"))
    top = sums.agg(F.max(F.struct("bytes", "pair")).alias("t")).select("t.pair").withColumn("is_largest", F.lit(True))
    return sums.join(F.broadcast(top), "pair", "left").withColumn("is_largest", F.coalesce("is_largest", F.lit(False)))  # one row


def upsert_runs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a run_id: the latest arrival, but IMMUTABLE columns keep their first value."""
    both = existing.unionByName(new)
    keep = [c for c in both.columns if c not in ("run_id", *IMMUTABLE)]
    return both.groupBy("run_id").agg(*[F.min_by(c, "arrival").alias(c) for c in IMMUTABLE], *[F.max_by(c, "arrival").alias(c) for c in keep])


def list_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The newest runs, by run_id among equals."""
    if not 1 <= n <= 1000:
        raise ValueError("the limit is 1 to 1000")
    return runs.orderBy(F.desc("updated_at"), "run_id").limit(n)


def profile_errors(events: DataFrame) -> DataFrame:
    """Error code of each profile event, NULL if it is sound. Events: phase, calls, total, longest."""
    code = F.when(~F.col("phase").isin(*PHASES) | F.col("phase").isNull(), "phase").when((F.col("calls") < 0) | (F.col("total") < 0) | (F.col("longest") < 0), "negative")
    return events.withColumn("error", code.when(F.col("longest") > F.col("total"), "longest_above_total").when((F.col("calls") == 0) & (F.col("total") != 0), "time_without_calls"))


def performance_report(runs: DataFrame, reference: str, candidate: str, memory_limit: float) -> DataFrame:
    """One row: the speed-up gate, the spread of both lanes and the share of representative runs."""
    gate = speedup_gate(runs, reference, candidate, memory_limit)
    spread = relative_spread(runs).where(F.col("lane").isin(reference, candidate)).agg(F.max("spread").alias("spread"))
    scope = scope_gate(runs).agg(F.count_if("representative").alias("representative_runs"))
    out = gate.crossJoin(spread).crossJoin(scope)  # one row each
    return out.withColumn("steady", F.coalesce(F.col("spread") <= MAX_SPREAD, F.lit(False)))
