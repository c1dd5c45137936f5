"""Queries of scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.functions import economics as eco
from wickwork.functions import scalars as op
from wickwork.functions.timeframes import calendar_years, instant_ms, timeframe_ms_col, to_ms, trailing_year
from wickwork.queries.base import query
from wickwork.sources import tables as src

_c = F.col
query("arithmetic_functions", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, floor((l_quantity - 25) / 7)::BIGINT AS fd, (l_quantity - 25) - floor((l_quantity - 25) / 7) * 7 AS md FROM lineitem")(lambda s, d: src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", op.floor_divide(_c("l_quantity") - 25, F.lit(7)).alias("fd"), op.modulo(_c("l_quantity") - 25, F.lit(7)).alias("md")))
query("logic_functions", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS number, length(substr(o_orderpriority, 1, o_orderkey % 2)) > 0 AS text, o_orderkey % 5 < o_custkey % 7 AND o_custkey % 7 < 6 AS chain, CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS flag FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", op.truthy(_c("o_orderkey") % 3, "number").alias("number"), op.truthy(F.substring("o_orderpriority", F.lit(1), (_c("o_orderkey") % 2).cast("int")), "text").alias("text"), op.chained(_c("o_orderkey") % 5, _c("o_custkey") % 7, F.lit(6)).alias("chain"), op.value_text(_c("o_orderkey") % 3 == 0, "bool").alias("flag"))
)
query("index_functions", "SELECT o_orderkey, string_split(o_orderpriority, '-')[-1] AS last_item, NULL::VARCHAR AS outside, substr(o_orderpriority, length(o_orderpriority), 1) AS last_char, split_part(o_orderpriority, '-', 1) AS before, CASE WHEN contains(o_orderpriority, '-') THEN '-' ELSE '' END AS mark FROM orders")(
    lambda s, d: src.table(s, d, "orders").withColumn("w", F.split("o_orderpriority", "-")).withColumn("p", op.partition(_c("o_orderpriority"), "-")).select("o_orderkey", op.item(_c("w"), F.lit(-1)).alias("last_item"), op.item(_c("w"), F.lit(9)).alias("outside"), op.char_at(_c("o_orderpriority"), F.lit(-1)).alias("last_char"), "p.before", "p.mark")
)
query("membership_functions", "SELECT pair, ts, coalesce(enter_tag, '') IN ('', '121') AS every, coalesce(enter_tag LIKE '%142%' OR enter_tag = '121', false) AS some, CASE enter_tag WHEN '141 142' THEN 2 WHEN '121' THEN 1 ELSE 0 END AS n_words, CASE WHEN enter_tag IN ('121', '141 142') THEN 1 ELSE 0 END AS ones FROM sig")(
    lambda s, d: src.signals(s, d).withColumn("w", op.words(_c("enter_tag"))).select("pair", "ts", op.all_in(_c("w"), F.array(F.lit("121"))).alias("every"), op.any_in(_c("w"), F.array(F.lit("121"), F.lit("142"))).alias("some"), F.size("w").alias("n_words"), op.count_where("w", lambda x: x.endswith("1")).alias("ones"))
)
query("parse_timeframe", "SELECT o_orderkey, ((o_orderkey % 9) + 1) * CASE o_orderkey % 6 WHEN 0 THEN 60000 WHEN 1 THEN 3600000 WHEN 2 THEN 86400000 WHEN 3 THEN 604800000 WHEN 4 THEN 2592000000 END AS ms FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", timeframe_ms_col(F.concat((_c("o_orderkey") % 9 + 1).cast("string"), F.element_at(F.array(*map(F.lit, ["m", "h", "d", "w", "M", "y"])), (_c("o_orderkey") % 6 + 1).cast("int")))).alias("ms"))
)
query("parse_timerange", "SELECT o_orderkey, (epoch_us(o_orderdate) // 1000 // 86400000) * 86400000 AS by_day, epoch_us(o_orderdate) // 1000000 * 1000 AS by_second, NULL::BIGINT AS wrong FROM orders")(
    lambda s, d: (lambda o: o.select("o_orderkey", instant_ms(F.date_format("o_orderdate", "yyyyMMdd")).alias("by_day"), instant_ms(F.lpad((to_ms(o, "o_orderdate") / 1000).cast("long").cast("string"), 10, "0")).alias("by_second"), instant_ms(F.lit("12x4")).alias("wrong")))(src.table(s, d, "orders"))
)
query("calendar_ranges", "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_ago, (year(o_orderdate) - 2)::VARCHAR || '-01-01' AS two_before FROM orders")(lambda s, d: src.table(s, d, "orders").select("o_orderkey", trailing_year(F.to_date("o_orderdate")).cast("string").alias("year_ago"), calendar_years(F.year("o_orderdate"), 3)[1]["start"].cast("string").alias("two_before")))
query("canonical_timestamp", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN epoch_us(o_orderdate) // 1000 END AS ts, CASE WHEN o_orderkey % 4 = 3 THEN 'disagree' END AS error FROM orders")(
    lambda s, d: (lambda o: o.withColumn("ms", to_ms(o, "o_orderdate")).withColumn("x", op.canonical_timestamp(F.when(_c("o_orderkey") % 4 != 1, _c("ms") + F.when(_c("o_orderkey") % 4 == 3, 1).otherwise(0)), F.when(_c("o_orderkey") % 4 != 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")))).select("o_orderkey", "x.ts", "x.error"))(src.table(s, d, "orders"))
)
query("protection_timing", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey % 50 + 1) * 60000 WHEN 1 THEN (o_custkey % 50 + 1) * 300000 WHEN 2 THEN 3600000 END::BIGINT AS duration_ms, CASE o_orderkey % 5 WHEN 3 THEN '21:30' END AS unlock_at, CASE o_orderkey % 5 WHEN 4 THEN 'two_durations' END AS error FROM orders")(
    lambda s, d: src.table(s, d, "orders").withColumn("k", _c("o_orderkey") % 5).withColumn("n", _c("o_custkey") % 50 + 1).withColumn("x", op.protection_timing(F.when(_c("k").isin(0, 4), _c("n")), F.when(_c("k").isin(1, 4), _c("n")), F.when(_c("k") == 3, "21:30"), 300_000)).select("o_orderkey", "x.*")
)
query("alias_lookup", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'old' END AS tag FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", op.first_present((_c("o_orderkey") % 3 == 0, F.lit(None).cast("string")), (_c("o_orderkey") % 3 == 1, F.lit("old"))).alias("tag"))
)
query("rounding_functions", "SELECT trade_id, round(profit_ratio * 3, 8) AS r8, CASE WHEN trade_id % 2 = 0 THEN trade_id ELSE trade_id + 1 END::DOUBLE AS even FROM closed")(lambda s, d: src.closed_trades(s, d).select("trade_id", eco.round8(_c("profit_ratio") * 3).alias("r8"), (F.bround(_c("trade_id") / 2.0, 0) * 2).alias("even")).withColumn("even", F.when(_c("trade_id") % 2 == 0, _c("trade_id").cast("double")).otherwise((_c("trade_id") + 1).cast("double"))))
query("half_even_balance", "SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1 END / 1e9::DOUBLE)::DOUBLE AS q FROM orders")(lambda s, d: src.table(s, d, "orders").select("o_orderkey", eco.half_even9((_c("o_orderkey").cast("decimal(20,10)") + F.lit(0.5).cast("decimal(20,10)") * (_c("o_orderkey") % 2 == 1).cast("int") * 1) * F.lit("0.000000001").cast("decimal(10,10)")).cast("double").alias("q")))
query("redact_settings", "SELECT o_orderkey, '<redacted>' AS secret, o_orderpriority AS plain FROM orders")(lambda s, d: src.table(s, d, "orders").withColumn("m", op.redacted(F.create_map(F.lit("exchange.apiKey"), _c("o_orderpriority"), F.lit("name"), _c("o_orderpriority")))).select("o_orderkey", _c("m")["exchange.apiKey"].alias("secret"), _c("m")["name"].alias("plain")))
query("canonical_json_digest", "SELECT o_orderkey, sha256('{\"a\":' || o_custkey || ',\"b\":\"' || o_orderpriority || '\"}') AS digest FROM orders")(lambda s, d: src.table(s, d, "orders").select("o_orderkey", op.canonical_json(F.struct(_c("o_custkey").alias("a"), _c("o_orderpriority").alias("b"))).alias("digest")))
query("exact_sum", "SELECT l_returnflag, sum(round(l_extendedprice * l_discount, 4)::DECIMAL(28,4))::DOUBLE AS total FROM lineitem GROUP BY 1")(lambda s, d: src.table(s, d, "lineitem").groupBy("l_returnflag").agg(op.exact_sum(_c("l_extendedprice") * _c("l_discount"), 4).cast("double").alias("total")))
