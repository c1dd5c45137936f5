"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

DataFrame functions only. Rows get a stable id, source blocks are cut from it, and the matrix of
block-to-shard counts is drawn exactly: a binary tree over the blocks halves the shard capacities
with multivariate hypergeometric draws, all nodes of a level at once. Each block then permutes its
rows and deals out its counts, and each shard permutes what it got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.llm.common import chunk_bits, running, shared_dir, unit, with_chunk, with_row_id

#: Rows of one source block at most; a block is permuted inside one task.
BLOCK_ROWS = 65_536


def _let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _steps(first: Column, last: Column, by: int) -> Column:
    some = first <= last if by > 0 else first >= last
    return F.when(some, F.sequence(first, last, F.lit(by).cast("long"))).otherwise(F.array().cast("array<long>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Inverse-transform draw of the marked items among `drawn` of `total`.

    Weights relative to the mode are summed over nine deviations to both sides, beyond which less
    than a double's resolution is left, and walked until the weight u is reached.
    """

    def body(p: Column) -> Column:
        n, k, d = p["total"], p["marked"], p["drawn"]
        lo, hi = F.greatest(F.lit(0).cast("long"), d - (n - k)), F.least(d, k)
        mode = F.least(hi, F.greatest(lo, F.floor((d + 1.0) * (k + 1.0) / (n + 2.0)).cast("long")))
        spread = F.ceil(9 * F.sqrt(d * 1.0 * (k / F.greatest(n, F.lit(1))) * ((n - k) / F.greatest(n, F.lit(1))) * ((n - d) / F.greatest(n - 1, F.lit(1)))) + 12).cast("long")
        return _let(F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("mode"), F.greatest(lo, mode - spread).alias("lo"), F.least(hi, mode + spread).alias("hi"), p["u"].alias("u")), walk)

    def walk(v: Column) -> Column:
        one = lambda w, c, x: F.struct(w.cast("double").alias("w"), c.cast("double").alias("c"), x.cast("long").alias("x"))
        ratio = lambda x: (v["k"] - x + 1.0) * (v["d"] - x + 1.0) / (x * 1.0 * (v["n"] - v["k"] - v["d"] + x))  # noqa: E731  weight of x by that of x - 1
        up, down = _steps(v["mode"] + 1, v["hi"], 1), _steps(v["mode"], v["lo"] + 1, -1)
        add_up = lambda a, x: _let(a["w"] * ratio(x), lambda w: one(w, a["c"] + w, x))
        add_down = lambda a, x: _let(a["w"] / ratio(x), lambda w: one(w, a["c"] + w, x - 1))
        at_mode, below = one(F.lit(1.0), F.lit(1.0), v["mode"]), one(F.lit(1.0), F.lit(0.0), v["mode"])

        def pick(s: Column) -> Column:
            target = v["u"] * (s["up"] + s["down"])
            to = lambda add, aim: lambda a, x: F.when(a["c"] > aim, a).otherwise(add(a, x))
            return F.when(target < s["up"], F.aggregate(up, at_mode, to(add_up, target))["x"]).otherwise(F.aggregate(down, below, to(add_down, target - s["up"]))["x"])

        return _let(F.struct(F.aggregate(up, at_mode, add_up)["c"].alias("up"), F.aggregate(down, below, add_down)["c"].alias("down")), pick)

    return _let(F.struct(total.cast("long").alias("total"), marked.cast("long").alias("marked"), drawn.cast("long").alias("drawn"), u.alias("u")), body)


def hypergeometric_vector(room: Column, drawn: Column, seed: Column) -> Column:
    """Counts by shard of `drawn` items taken at random from shards with the capacities `room`."""
    start = F.struct(drawn.cast("long").alias("left"), F.aggregate(room, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array().cast("array<long>").alias("got"))

    def step(a: Column, j: Column) -> Column:
        here = F.element_at(room, (j + 1).cast("int"))
        return _let(hypergeometric(a["total"], here, a["left"], unit(seed, j)), lambda x: F.struct((a["left"] - x).alias("left"), (a["total"] - here).alias("total"), F.concat(a["got"], F.array(x)).alias("got")))

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step)["got"]


def communication_matrix(blocks: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """Rows (block, ends): running counts by shard of what each block sends. blocks: (block, n), block dense from 0."""
    count = blocks.count()
    depth = max(0, count - 1).bit_length()
    room = F.array(*[F.lit(int(x)).cast("long") for x in sizes])
    nodes = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), room.alias("room"))
    for level in range(1, depth + 1):
        left = blocks.groupBy(F.shiftright("block", depth - level).alias("child")).agg(F.sum("n").alias("n")).where("child % 2 = 0").select((F.col("child") / 2).cast("long").alias("node"), "n")
        drawn = nodes.join(left, "node").withColumn("got", hypergeometric_vector(F.col("room"), F.col("n"), F.xxhash64(F.lit(seed), F.lit(level), "node")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("room")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("room", "got", lambda a, b: a - b).alias("room")))
        nodes = drawn.select(F.explode(halves).alias("h")).select("h.*").where(F.aggregate("room", F.lit(0).cast("long"), lambda a, x: a + x) > 0)
        if level % 4 == 0:
            nodes = nodes.checkpoint()
    ends = F.aggregate("room", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0).cast("long")))))
    return nodes.select(F.col("node").alias("block"), ends.alias("ends"))


def shard_uniform(df: DataFrame, shards: int, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Put all rows into shards whose counts differ by one at most, in uniformly random order.

    Adds shard (int, from 0) and slot (long, gapless from 0 inside the shard); law is "rows". Every
    input row comes back once, nulls, repeated rows and empty texts included; an empty table gives an
    empty result. Input columns named shard or slot are replaced; names starting with _ are reserved. Rows are
    numbered by file and place, so neither a lost executor nor other cores change the outcome. Other files or another seed give another shuffle.
    """
    spark = df.sparkSession
    shared_dir(spark)
    df = df.drop("shard", "slot")
    rows = with_row_id(df)
    inside = F.col("_rid").bitwiseAND(F.lit((1 << 40) - 1))
    rows = rows.withColumn("_key", F.shiftright("_rid", 40) * F.lit(1 << 22) + F.floor(inside / block_rows)).checkpoint()
    blocks = rows.groupBy("_key").agg(F.count("*").alias("n")).withColumn("block", F.row_number().over(Window.orderBy("_key")) - 1).withColumn("block", F.col("block").cast("long")).checkpoint()
    count = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    sizes = [count // shards + (j < count % shards) for j in range(shards)]
    sent = blocks.join(communication_matrix(blocks, sizes, seed), "block").select("_key", "ends")
    local = Window.partitionBy("_key").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "_rid"), "_rid")
    dealt = rows.withColumn("_at", F.row_number().over(local) - 1).join(sent, "_key")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_at"))).cast("int")).withColumn("_mix", F.xxhash64(F.lit(seed), F.lit("shard"), "_rid"))
    dealt = with_chunk(dealt, "_mix", chunk_bits(count // shards)).drop("ends", "_at", "_key").checkpoint()
    order = [F.shiftrightunsigned("_mix", 1), "_mix", "_rid"]
    return running(dealt, ["shard"], "_chunk", order, None, "_n").withColumn("slot", F.col("_n") - 1).select(*df.columns, "shard", "slot")
