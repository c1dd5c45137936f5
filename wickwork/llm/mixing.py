"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickwork.llm.common import chunk_bits, drop_stored, running, stored, with_row_id

#: A document is taken this often at most; a source's target stops at so many times its size.
MOST_REPEATS = 3
#: Fixed value: what parts a text into the words that sizes count.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """(source_no, source, source_size, target) from (source, size): weights 1, 2, 3 by code point order, null last.

    All sizes together are shared by weight; a target stops at `repeats` times its source's size, and
    what is above goes to the others by weight. With sources sorted by the level at which they fill
    up, the common level follows from running sums, which gives the fixpoint of the repeated sharing.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int")).withColumn("weight", F.col("source_no") % 3 + 1)
    fill = F.col("source_size") * float(repeats) / F.col("weight")
    filled = Window.orderBy(F.col("fill"), F.col("source_no"))
    level = ranked.withColumn("fill", fill)
    ahead = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("source_size").over(ahead), F.lit(0)) * repeats)
    level = level.withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("level", F.col("rest") / F.col("open"))
    at = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(Window.partitionBy())  # levels fall from the first that fits on
    target = F.least(F.col("source_size") * float(repeats), at * F.col("weight"))
    return level.select("source_no", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def fair_queue(docs: DataFrame, size: str = "size", seed: str = "mix", repeats: int = MOST_REPEATS) -> DataFrame:
    """How many words the mix takes of each document: adds source_size, target, copies (int), taken (long) and first_finish.

    docs needs doc_id, source and a long column `size`; other columns are carried. Documents of a
    source are shuffled by a hash of doc_id and queue up, up to `repeats` rounds. The virtual finish time
    of a copy is its source's words up to and with it over the source's target; copies are served in that
    order over all sources until the words of all documents are used up. Totals by range of finish
    time find the range in which that happens; only its copies are put in one order.

    Nulls: a null doc_id is an id like any other, a null source is the last source, a null size
    counts 0. Documents of size 0 are never taken. Equal rows are interchangeable. No sources or sizes of 0 only: nothing
    is taken. Input columns with the added names are replaced; names that start with _ are reserved.

    Totals by range of finish time go through one task, one row for about 20,000 documents.
    """
    given = [c for c in docs.columns if c not in ("source_size", "target", "copies", "taken", "first_finish")]
    size_of = F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_key")
    base = docs.select(F.struct(*given).alias("_row"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), size_of, key)
    targets = source_targets(base.select(F.col("_source").alias("source"), F.col("_size").alias("size")), repeats)
    targets = stored(targets.select(F.col("source_no").alias("_no"), F.col("source").alias("_name"), F.col("source_size").alias("_total"), F.col("target").alias("_target")), "targets")
    count = base.count()
    digits = -(-chunk_bits(count) // 4)
    base = base.join(targets, base["_source"].eqNullSafe(targets["_name"])).drop("_source", "_name")
    base = stored(base.withColumn("_chunk", F.substring("_key", 1, digits) if digits else F.lit("")), "queue")
    order = ["_key", "_id", "_size"]
    queued = running(base, ["_no"], "_chunk", order, "_size", "_upto")
    queued = stored(queued.withColumn("_first", F.when(F.col("_target") > 0, F.col("_upto") / F.col("_target"))), "queued")
    finish = (F.col("_round") * F.col("_total") + F.col("_upto")) / F.col("_target")
    copies = queued.where("_size > 0 and _target > 0").drop("_row").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_finish", finish)
    per_unit = max(2048, count // 20_000)
    copies = copies.withColumn("_range", F.floor(F.col("_finish") * per_unit).cast("long"))
    ranges = copies.groupBy("_range").agg(F.sum("_size").alias("s")).withColumn("upto", F.sum("s").over(Window.orderBy("_range")))
    budget = base.agg(F.coalesce(F.sum("_size"), F.lit(0)).cast("long")).first()[0]
    drop_stored(targets, base)
    full = ranges.where(F.col("upto") > budget).orderBy("_range").select("_range", F.col("upto") - F.col("s")).first()
    if full is None:
        served = F.lit(repeats)
    else:
        edge = copies.where(F.col("_range") == full[0]).withColumn("_all", F.sum("_size").over(Window.orderBy("_finish", "_no", *order, "_round").rowsBetween(Window.unboundedPreceding, 0)))
        last = edge.where(F.col("_all") <= budget - full[1]).orderBy(F.desc("_all")).select("_finish", "_no", "_key", "_size").first()
        served = _served(full[0], last, repeats, per_unit)
    copies_of = F.when((F.col("_size") > 0) & (F.col("_target") > 0), served).otherwise(0).cast("int")
    return queued.select(*[F.col("_row")[c].alias(c) for c in given], F.col("_total").alias("source_size"), F.col("_target").alias("target"), copies_of.alias("copies"), (copies_of * F.col("_size")).alias("taken"), F.col("_first").alias("first_finish"))


def _served(at: int, last, repeats: int, per_unit: int):
    """Number of rounds of a row that end no later than the last copy served."""
    total = F.lit(0)
    for k in range(repeats):
        finish = (F.lit(k) * F.col("_total") + F.col("_upto")) / F.col("_target")
        within = F.floor(finish * per_unit).cast("long") < at
        if last is not None:
            tie = F.struct(finish.alias("a"), F.col("_no").alias("b"), F.col("_key").alias("c"), F.col("_size").alias("d"))
            end = F.struct(*[F.lit(v).alias(n) for n, v in zip("abcd", last)])
            within = within | (tie <= end)
        total = total + F.coalesce(within, F.lit(False)).cast("int")
    return total


def mixed_documents(docs: DataFrame, size: str = "size", seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, range-sorted by virtual finish time. All columns are kept; names that start with _ are reserved.

    The queue works on sizes alone; texts are joined by the number of their stored row.
    """
    rows = with_row_id(docs)
    queued = fair_queue(rows.select("_rid", "doc_id", "source", F.col(size).alias("_words")), "_words", seed).where("copies > 0")
    rounds = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: k * F.col("source_size") / F.col("target") + F.col("first_finish"))
    served = queued.select("_rid", rounds.alias("_served"))
    return rows.join(served, "_rid").withColumn("_finish", F.explode("_served")).orderBy("_finish").select(*docs.columns)
