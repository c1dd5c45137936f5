"""Queries of the signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickwork.operators import signals as op
from wickwork.queries.base import query
from wickwork.sources import tables as src

TIMES = [1_704_672_000_000, 1_705_276_800_000]
RULES = [(["121"], 3.0), (["141", "142", "143"], 2.0)]

query("shift_signals", "SELECT pair, ts, coalesce(lag(enter_long) OVER w, 0) AS exec_enter_long, coalesce(lag(exit_long) OVER w, 0) AS exec_exit_long, coalesce(lag(enter_short) OVER w, 0) AS exec_enter_short, lag(nullif(enter_tag, '')) OVER w AS exec_enter_tag FROM sig WINDOW w AS (PARTITION BY pair ORDER BY ts)")(lambda s, d: op.shift_signals(src.signals(s, d)).select("pair", "ts", "exec_enter_long", "exec_exit_long", "exec_enter_short", "exec_enter_tag"))
query("normalize_tag", "SELECT pair, ts, nullif(enter_tag, '') AS tag FROM sig")(lambda s, d: src.signals(s, d).select("pair", "ts", op.normalize_tag(F.col("enter_tag")).alias("tag")))
query("is_enabled", "SELECT pair, ts, coalesce(CASE WHEN volume = 0 THEN NULL ELSE close > open END, false) AS is_on FROM cf")(lambda s, d: src.full_candles(s, d).select("pair", "ts", op.is_enabled(F.when(F.col("volume") == 0, float("nan")).otherwise((F.col("close") > F.col("open")).cast("double"))).alias("is_on")))
query("signal_counts", "SELECT pair, count(*) AS rows, count(*) FILTER (enter_long <> 0) AS enter_long, count(*) FILTER (enter_short <> 0) AS enter_short, count(*) FILTER (exit_long <> 0) AS exit_long, count(*) FILTER (exit_short <> 0) AS exit_short FROM sig GROUP BY pair")(lambda s, d: op.signal_counts(src.signals(s, d)))
query("signal_rows", "SELECT pair, count(*) AS rows, count(*) FILTER (x) AS signal_rows, (coalesce(sum(('0x' || substr(md5(concat_ws('|', ts, enter_long, enter_short, exit_long, exit_short, coalesce(enter_tag, '-'), coalesce(exit_tag, '-'))), 1, 12))::BIGINT) FILTER (x), 0)::HUGEINT % 281474976710656)::BIGINT AS digest FROM (SELECT *, enter_long + exit_long <> 0 AS x FROM sig) GROUP BY pair")(lambda s, d: op.signal_rows(src.signals(s, d)))
query("signal_feature_samples", f"SELECT pair, ts, close, volume FROM sig WHERE ts IN ({TIMES[0]}, {TIMES[1]}) OR enter_long + exit_long <> 0")(lambda s, d: op.signal_feature_samples(src.signals(s, d), TIMES, ["close", "volume"]))
query("tag_scope", "SELECT pair, ts, coalesce(enter_tag = '121', false) AS supported, CASE WHEN enter_tag = '141 142' THEN '142' ELSE '' END AS unknown_words FROM sig")(lambda s, d: op.tag_scope(src.signals(s, d), ["121", "141"]).select("pair", "ts", "supported", "unknown_words"))
query("entry_eligible", "SELECT pair, ts, ts < max(ts) OVER (PARTITION BY pair) AS entry_eligible FROM sig")(lambda s, d: op.entry_eligible(src.signals(s, d)).select("pair", "ts", "entry_eligible"))
query("first_entry_signal", "SELECT pair, ts, min(CASE WHEN enter_long = 1 THEN ts END) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_entry_ts FROM sig")(lambda s, d: op.next_entry(src.signals(s, d)).select("pair", "ts", "next_entry_ts"))
query("tag_leverage", "SELECT pair, ts, CASE WHEN coalesce(enter_tag, '') IN ('', '121') THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS leverage FROM sig")(lambda s, d: src.signals(s, d).select("pair", "ts", op.tag_leverage(F.col("enter_tag"), RULES, 1.0).alias("leverage")))
query("entry_leverage", "SELECT pair, ts, greatest(1.0, least(CASE WHEN volume > 3 THEN 5.0 WHEN coalesce(enter_tag, '') IN ('', '121') THEN 3.0 ELSE 2.0 END, CASE WHEN close > 50 THEN 4.0 ELSE 2.5 END))::DOUBLE AS leverage FROM sig")(
    lambda s, d: src.signals(s, d).select("pair", "ts", op.entry_leverage(F.when(F.col("volume") > 3, 5.0), op.tag_leverage(F.col("enter_tag"), RULES, 1.0), F.lit(1.0), F.when(F.col("close") > 50, 4.0).otherwise(2.5)).alias("leverage"))
)
