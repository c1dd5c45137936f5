"""Queries of the comparison operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import compare as op
from wickwork.operators.trades import closure_sequence
from wickwork.queries.base import query
from wickwork.sources import tables as src

FIELDS = ["trade_id", "pair", "is_short", "open_ts", "close_ts", "amount", "entries"]
_SEQ = "SELECT row_number() OVER (ORDER BY close_ts, trade_id) - 1 AS sequence, trade_id, pair, is_short, open_ts, close_ts, amount, entries FROM closed"
_B = "SELECT * REPLACE (CASE WHEN trade_id % 1000 = 7 THEN amount + 1 ELSE amount END AS amount) FROM sa"
_FLOATS = "'float' AS expected_type, 'float' AS actual_type"
_FRAGMENT = """'{"trade_id":' || f.trade_id || ',"pair":"' || f.pair || '","is_short":' || f.is_short || ',"open_ts":' || f.open_ts || ',"close_ts":' || f.cutoff || ',"amount":' || printf('%%.1f', f.amount + %d) || ',"entries":' || f.entries || '}'"""
_DIFF = "SELECT sa.sequence, 5 AS ord, 'amount' AS field, sa.amount AS e, sb.amount AS a FROM sa JOIN sb USING (sequence) WHERE sa.amount <> sb.amount"


def expected(s, d):
    return closure_sequence(src.closed_trades(s, d).select(*FIELDS, "exit_reason")).select("sequence", *FIELDS)


def actual(s, d):
    return expected(s, d).withColumn("amount", F.when(F.col("trade_id") % 1000 == 7, F.col("amount") + 1).otherwise(F.col("amount")))


query("surface_diff", f"SELECT '$.trades[' || sequence || '].amount' AS path, printf('%.1f', e) AS expected, printf('%.1f', a) AS actual, {_FLOATS}, 'value' AS reason FROM df ORDER BY sequence LIMIT 1", sa=_SEQ, sb=_B, df=_DIFF)(lambda s, d: op.surface_diff(expected(s, d), actual(s, d)))
query("surface_differences", f"SELECT sequence, field, {_FLOATS}, printf('%.1f', e) AS expected, printf('%.1f', a) AS actual, 'value' AS reason FROM df", sa=_SEQ, sb=_B, df=_DIFF)(lambda s, d: op.differences(expected(s, d), actual(s, d)).drop("ord"))
query("surface_diff_length", "SELECT '$.trades.length' AS path, count(*)::VARCHAR AS expected, (max(sequence) - 4)::VARCHAR AS actual, 'int' AS expected_type, 'int' AS actual_type, 'length' AS reason FROM sa", sa=_SEQ)(
    lambda s, d: (lambda e: op.surface_diff(e, e.join(e.agg((F.max("sequence") - 4).alias("m")), F.col("sequence") < F.col("m")).drop("m")))(expected(s, d))
)


def nested(s, d):
    """Trades with their orders, by position."""
    orders = src.trade_orders(s, d).groupBy("trade_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.col("amount").cast("long").alias("amount"), "is_entry"))).alias("orders"))
    return expected(s, d).select("sequence", "trade_id", "pair", "entries").join(orders, "trade_id").select("sequence", "pair", "orders", "entries")


def tampered(s, d):
    """nested() with a difference of each kind, by residue of the trade: 3 a longer array, 4 a missing key, 5 another type, 6 a further key, 7 a value below an array."""
    rows = nested(s, d).withColumn("_k", F.col("sequence") % 1000)
    rows = rows.withColumn("orders", F.when(F.col("_k") == 3, F.concat("orders", F.slice("orders", 1, 1))).when(F.col("_k") == 7, F.transform("orders", lambda o, i: o.withField("amount", o["amount"] + (i == 1).cast("int")))).otherwise(F.col("orders")))
    doc = F.to_json(F.struct("pair", "orders", "entries"))
    doc = F.when(F.col("_k") == 4, F.to_json(F.struct("pair", "orders"))).when(F.col("_k") == 5, F.to_json(F.struct("pair", "orders", F.col("entries").cast("string").alias("entries")))).when(F.col("_k") == 6, F.to_json(F.struct("pair", "orders", "entries", F.lit(1).alias("extra")))).otherwise(doc)
    return rows.select(F.col("sequence").alias("key"), doc.alias("doc"))


_NEST = "SELECT sequence, entries, n, second FROM sa JOIN (SELECT trade_id, count(*) AS n, max(amount::BIGINT) FILTER (sequence = 1) AS second FROM tord GROUP BY trade_id) USING (trade_id)"
_TAMPERED = """SELECT sequence AS key, '.orders.length' AS path, n::VARCHAR AS expected, (n + 1)::VARCHAR AS actual, 'list' AS expected_type, 'list' AS actual_type, 'length' AS reason FROM ne WHERE sequence % 1000 = 3
UNION ALL SELECT sequence, '.entries', entries::VARCHAR, NULL, 'int', NULL, 'missing' FROM ne WHERE sequence % 1000 = 4
UNION ALL SELECT sequence, '.entries', entries::VARCHAR, entries::VARCHAR, 'int', 'str', 'type' FROM ne WHERE sequence % 1000 = 5
UNION ALL SELECT sequence, '.extra', NULL, '1', NULL, 'int', 'unexpected' FROM ne WHERE sequence % 1000 = 6
UNION ALL SELECT sequence, '.orders[1].amount', second::VARCHAR, (second + 1)::VARCHAR, 'int', 'int', 'value' FROM ne WHERE sequence % 1000 = 7"""
query("document_differences", _TAMPERED, sa=_SEQ, ne=_NEST)(lambda s, d: op.document_differences(op.differing_rows(op.document(nested(s, d), "sequence"), tampered(s, d))).drop("ord"))
query("surface_diff_nested", "SELECT '$.trades[3].orders.length' AS path, n::VARCHAR AS expected, (n + 1)::VARCHAR AS actual, 'list' AS expected_type, 'list' AS actual_type, 'length' AS reason FROM ne WHERE sequence = 3", sa=_SEQ, ne=_NEST)(
    lambda s, d: op.first_difference(op.differing_rows(op.document(nested(s, d), "sequence"), tampered(s, d)))
)
query("trade_fragment", "SELECT *, 'expected' AS side FROM sa WHERE sequence = 11 UNION ALL SELECT *, 'actual' FROM sb WHERE sequence = 11", sa=_SEQ, sb=_B)(lambda s, d: op.fragment(expected(s, d), actual(s, d), 11))
_CONF = "SELECT (SELECT count(*) FROM sa) AS expected_rows, (SELECT count(*) FROM sb) AS actual_rows, (SELECT count(*) FROM df) AS differing_rows, '$.trades[' || sequence || '].amount' AS path, printf('%.1f', e) AS expected, printf('%.1f', a) AS actual, 'float' AS expected_type, 'float' AS actual_type, 'value' AS reason, false AS equal FROM df ORDER BY sequence LIMIT 1"
query("confirmation_report", _CONF, sa=_SEQ, sb=_B, df=_DIFF)(lambda s, d: op.confirmation_report(expected(s, d), actual(s, d)))
query("mismatch_report", "SELECT co.*, cutoff, fragment(e, false) AS expected_fragment, fragment(e, true) AS actual_fragment, (SELECT count(*) FROM cf WHERE ts <= cutoff) AS replay_candles, (SELECT count(DISTINCT pair) FROM cf WHERE ts <= cutoff) AS replay_pairs FROM co, (SELECT sa.*, close_ts + 1000000000000 AS cutoff FROM sa WHERE sequence = (SELECT min(sequence) FROM df)) f".replace("fragment(e, false)", _FRAGMENT % 0).replace("fragment(e, true)", _FRAGMENT % 1), sa=_SEQ, sb=_B, df=_DIFF, co=_CONF)(
    lambda s, d: op.mismatch_report(*[x.withColumn("close_ts", F.col("close_ts") + 1_000_000_000_000) for x in (expected(s, d), actual(s, d))], src.full_candles(s, d))
)
query("validate_surface", "SELECT sequence, CASE WHEN sequence % 7 = 3 THEN 'decimal' ELSE 'time' END AS code FROM sa WHERE sequence % 7 = 3 OR sequence % 11 = 4", sa=_SEQ)(
    lambda s, d: op.validate_surface(expected(s, d).withColumn("text", F.when(F.col("sequence") % 7 == 3, F.concat(F.col("trade_id").cast("string"), F.lit(".50"))).otherwise(F.col("trade_id").cast("string"))).withColumn("close_ts", F.when(F.col("sequence") % 11 == 4, F.col("open_ts") - 1).otherwise(F.col("close_ts"))), ["text"])
)
query("canonical_decimal", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber = 1 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.2f', l_extendedprice), '0+$', ''), '\\.$', '') END AS text FROM lineitem")(
    lambda s, d: src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", op.canonical_decimal(F.when(F.col("l_linenumber") == 1, "-0.000").otherwise(F.concat(F.format_string("%.4f", "l_extendedprice"), F.lit("e0")))).alias("text"))
)


def events(s, d):
    """State events, one a trade."""
    e = expected(s, d)
    return e.select("sequence", F.col("close_ts").alias("ts"), F.lit("close").alias("phase"), "pair", F.lit("exit").alias("callback"), F.concat(F.lit('{"amount":'), F.col("amount").cast("long").cast("string"), F.lit("}")).alias("state"))


_EVT = "SELECT sequence, close_ts AS ts, 'close' AS phase, pair, 'exit' AS callback, '{\"amount\":' || amount::BIGINT || '}' AS state FROM sa"
_EVH = "SELECT *, sha256(state) AS state_hash, sha256(concat_ws(chr(10), sequence, ts, phase, pair, callback, sha256(state))) AS event_hash FROM evt"
query("event_hashes", "SELECT sequence, state_hash, event_hash FROM evh", sa=_SEQ, evt=_EVT, evh=_EVH)(lambda s, d: op.hashed_events(events(s, d)).select("sequence", "state_hash", "event_hash"))
query("trace_digest", "SELECT sum(n)::BIGINT AS events, sha256(string_agg(x, chr(10) ORDER BY c)) AS digest FROM (SELECT sequence // 10000 AS c, count(*) AS n, sha256(string_agg(event_hash, chr(10) ORDER BY sequence)) AS x FROM evh GROUP BY 1)", sa=_SEQ, evt=_EVT, evh=_EVH)(lambda s, d: op.trace_digest(op.hashed_events(events(s, d))))
query("validate_events", "SELECT 500::BIGINT AS sequence, 'state_hash' AS code")(lambda s, d: op.validate_events(op.hashed_events(events(s, d)).withColumn("state", F.when(F.col("sequence") >= 500, "{}").otherwise(F.col("state")))))
query("trace_diff", "SELECT 77::BIGINT AS sequence, '$.state.amount' AS path, (SELECT amount::BIGINT::VARCHAR FROM sa WHERE sequence = 77) AS expected, NULL::VARCHAR AS actual, 'missing' AS reason", sa=_SEQ)(
    lambda s, d: op.trace_diff(op.hashed_events(events(s, d)), op.hashed_events(events(s, d).withColumn("state", F.when(F.col("sequence") >= 77, "{}").otherwise(F.col("state")))))
)
query("trace_diff_hashes", "SELECT 77::BIGINT AS sequence, '$.event_hash' AS path, (SELECT event_hash FROM evh WHERE sequence = 77) AS expected, (SELECT sha256(concat_ws(chr(10), sequence, ts, phase, pair, callback, sha256('{}'))) FROM evh WHERE sequence = 77) AS actual, 'value' AS reason", sa=_SEQ, evt=_EVT, evh=_EVH)(
    lambda s, d: op.trace_diff(op.hashed_events(events(s, d)).drop("state"), op.hashed_events(events(s, d).withColumn("state", F.when(F.col("sequence") >= 77, "{}").otherwise(F.col("state")))).drop("state"))
)
query("trace_diff_key", "SELECT 77::BIGINT AS sequence, '$.event_key.phase' AS path, 'close' AS expected, 'open' AS actual, 'value' AS reason")(
    lambda s, d: op.trace_diff(op.hashed_events(events(s, d)), op.hashed_events(events(s, d).withColumn("phase", F.when(F.col("sequence") >= 77, "open").otherwise(F.col("phase")))))
)
query("trace_diff_length", "SELECT 77::BIGINT AS sequence, '$.events.length' AS path, count(*)::VARCHAR AS expected, '77' AS actual, 'length' AS reason FROM sa", sa=_SEQ)(
    lambda s, d: op.trace_diff(op.hashed_events(events(s, d)), op.hashed_events(events(s, d)).where("sequence < 77"))
)
