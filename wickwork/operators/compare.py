"""Exact comparison of trade logs and state-event streams, down to the first differing field.

Rows become JSON documents, nested fields included, and are compared by digest first. Only documents that differ are taken apart, into one row a node with its path and
its place in document order, and joined in full by path; so a difference has an exact path at any depth, and the first one is a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wickwork.session import stored


def _power(exponent: Column) -> Column:
    """An exponent's number, 0 for an empty text: a zero goes before its digits, as a text that is no number costs an exception inside the cast."""
    return F.concat(F.lit("0"), F.ltrim(exponent, F.lit("+-"))).try_cast("int") * (1 - 2 * exponent.startswith("-").cast("int"))


def is_decimal(c: Column) -> Column:
    """Whether a text is a finite number, so that canonical_decimal is not null; NULL for NULL."""
    return F.trim(c).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$")


def canonical_decimal(c: Column) -> Column:
    """Decimal text without exponent, trailing zeros or a sign on zero; NULL for text that is not a finite number.

    Works on the text, so any number of digits is kept exactly. Exponents have four digits at most.
    """
    # no step stands in a branch, so that a projection evaluates each of them, and c, once
    zero = F.lit("0")
    text = F.replace(F.when(is_decimal(c), F.rtrim(F.trim(c), F.lit("\n\r\u0085\u2028\u2029"))), F.lit("E"), F.lit("e"))  # $ stands before a last line end too
    number = F.substring_index(text, "e", 1)
    bare = F.ltrim(number, F.lit("+-"))
    before = F.substring_index(bare, ".", 1)
    digits = F.concat(before, F.substring(bare, F.length(before) + 2, F.length(bare)))
    point = F.length(before) + _power(F.substring(text, F.length(number) + 2, F.length(text)))  # digits before the point
    padded = F.concat(F.repeat(zero, F.greatest(F.lit(0), 1 - point)), digits, F.repeat(zero, F.greatest(F.lit(0), point - F.length(digits))))
    at = F.greatest(point, F.lit(1))
    whole = F.ltrim(F.substring(padded, F.lit(1), at), zero)
    rest = F.rtrim(F.substring(padded, at + 1, F.length(padded)), zero)
    plain = F.concat(F.repeat(zero, 1 - F.least(F.length(whole), F.lit(1))), whole, F.repeat(F.lit("."), F.least(F.length(rest), F.lit(1))), rest)
    return F.concat(F.repeat(F.lit("-"), (number.startswith("-") & (plain != "0")).cast("int")), plain)


def canonical_decimals(texts: Column) -> Column:
    """canonical_decimal of every text of an array.

    Functions of array elements evaluate a step as often as it is named, so here each step is a pass over the array that carries on what later ones need.
    """
    zero = F.lit("0")

    def step(values: Column, keep: str = "", **made) -> Column:
        return F.transform(values, lambda v: F.struct(*[v[c].alias(c) for c in keep.split()], *[f(v).alias(c) for c, f in made.items()]))

    rows = F.transform(texts, lambda c: F.struct(F.replace(F.when(is_decimal(c), F.rtrim(F.trim(c), F.lit("\n\r\u0085\u2028\u2029"))), F.lit("E"), F.lit("e")).alias("text")))
    rows = step(rows, "text", number=lambda v: F.substring_index(v["text"], "e", 1))
    rows = step(rows, "text number", bare=lambda v: F.ltrim(v["number"], F.lit("+-")))
    rows = step(rows, "text number bare", before=lambda v: F.substring_index(v["bare"], ".", 1))
    power = lambda v: _power(F.substring(v["text"], F.length(v["number"]) + 2, F.length(v["text"])))
    rows = step(rows, "number", digits=lambda v: F.concat(v["before"], F.substring(v["bare"], F.length(v["before"]) + 2, F.length(v["bare"]))), point=lambda v: F.length(v["before"]) + power(v))
    rows = step(rows, "number", at=lambda v: F.greatest(v["point"], F.lit(1)), padded=lambda v: F.concat(F.repeat(zero, F.greatest(F.lit(0), 1 - v["point"])), v["digits"], F.repeat(zero, F.greatest(F.lit(0), v["point"] - F.length(v["digits"])))))
    rows = step(rows, "number", whole=lambda v: F.ltrim(F.substring(v["padded"], F.lit(1), v["at"]), zero), rest=lambda v: F.rtrim(F.substring(v["padded"], v["at"] + 1, F.length(v["padded"])), zero))
    one = lambda c: F.least(F.length(c), F.lit(1))
    rows = step(rows, "number", plain=lambda v: F.concat(F.repeat(zero, 1 - one(v["whole"])), v["whole"], F.repeat(F.lit("."), one(v["rest"])), v["rest"]))
    return F.transform(rows, lambda v: F.concat(F.repeat(F.lit("-"), (v["number"].startswith("-") & (v["plain"] != "0")).cast("int")), v["plain"]))


#: Types of document nodes; objects and arrays hold others.
OBJECT, ARRAY = "dict", "list"
#: Order keys: what only the actual side has comes after all of the expected side's keys; a length comes after all elements.
_EXTRA, _LENGTH = 1 << 30, (1 << 31) - 1
_NODES = "ord array<int>, path string, parent string, parent_type string, type string, value string, size int"
_DIFFS = ["key", "ord", "path", "expected", "actual", "expected_type", "actual_type", "reason"]


def document(df: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """(key, doc): each row's fields, nested ones too, as one JSON document in the order of the columns. Nulls stay."""
    fields = fields or [c for c in df.columns if c != key]
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("doc"))


def _flatten(text: str):
    """Nodes of one JSON document, each before its children: (ord, path, parent, parent's type, type, value, size). Keys keep the order of the text."""
    import json

    todo = [([], "", None, None, json.loads(text))]
    while todo:
        at, path, parent, parent_type, x = todo.pop()
        kind = type(x).__name__
        if isinstance(x, dict):
            children, value = [([*at, i], f"{path}.{k}", path, kind, v) for i, (k, v) in enumerate(x.items())], None
        elif isinstance(x, list):
            children, value = [([*at, i], f"{path}[{i}]", path, kind, v) for i, v in enumerate(x)], None
        else:
            children, value = [], x if isinstance(x, str) else json.dumps(x)
        yield at, path, parent, parent_type, kind, value, len(children)
        todo.extend(reversed(children))


def _nodes(docs: DataFrame) -> DataFrame:
    """All nodes of the documents (key, doc), one row each."""
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL(_NODES).fields])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, *n) for i, doc in enumerate(b.column(1).to_pylist()) for n in _flatten(doc)]
            if rows:
                at, *cells = zip(*rows)
                kinds = [pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(cells, kinds)]], schema.names)

    return docs.select("key", "doc").mapInArrow(run, schema)


def differing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, expected, actual): documents of the keys that differ, null where a side has none. Only digests of equal documents are shuffled with them."""
    digest = lambda df, h: df.select("key", F.sha2("doc", 256).alias(h))
    off = digest(expected, "ha").join(digest(actual, "hb"), "key", "full_outer").where("not (ha <=> hb)").select("key")
    out = off.join(expected.withColumnRenamed("doc", "expected"), "key", "left").join(actual.withColumnRenamed("doc", "actual"), "key", "left")
    return out.select("key", "expected", "actual")


def document_differences(rows: DataFrame) -> DataFrame:
    """Every structural difference of pairs of documents (key, expected, actual): key, ord, path below the document, both values and types, reason.

    Reasons: type, missing (a key that only expected has), unexpected (one that only actual has), length (of arrays, after their common elements) and value. Nothing below
    a difference is listed. ord sorts the differences of a document as a reader meets them who follows expected's keys and then actual's further ones.
    """
    both = rows.where("expected is not null and actual is not null")
    a, b = _nodes(both.select("key", F.col("expected").alias("doc"))), _nodes(both.select("key", F.col("actual").alias("doc")))
    x = a.select("key", "path", *[F.col(c).alias(f"a_{c}") for c in ("ord", "parent", "parent_type", "type", "value", "size")])
    y = b.select("key", "path", *[F.col(c).alias(f"b_{c}") for c in ("ord", "parent", "parent_type", "type", "value", "size")])
    nodes = x.join(y, ["key", "path"], "full_outer")
    is_both, array = F.col("a_type").isNotNull() & F.col("b_type").isNotNull(), F.col("a_type") == ARRAY
    reason = F.when(is_both & (F.col("a_type") != F.col("b_type")), "type").when(is_both & array & (F.col("a_size") != F.col("b_size")), "length")
    reason = reason.when(is_both & ~F.col("a_type").isin(OBJECT, ARRAY) & (F.col("a_value") != F.col("b_value")), "value")
    reason = reason.when(F.col("b_type").isNull() & (F.col("a_parent_type") == OBJECT), "missing").when(F.col("a_type").isNull() & (F.col("b_parent_type") == OBJECT), "unexpected")
    found = nodes.withColumn("reason", reason).where("reason is not null").withColumn("_up", F.coalesce("a_parent", "b_parent"))
    # a lone key counts only if both sides have its parent as an object; its place is below that of the parent on the expected side
    parents = nodes.where(is_both & (F.col("a_type") == OBJECT) & (F.col("b_type") == OBJECT)).select("key", F.col("path").alias("_up"), F.col("a_ord").alias("_up_ord"))
    alone = F.col("reason").isin("missing", "unexpected")
    found = found.where(~alone).withColumn("_up_ord", F.col("a_ord")).unionByName(found.where(alone).join(parents, ["key", "_up"]))
    last = lambda n: F.concat("_up_ord", F.array(n.cast("int")))
    order = F.when(F.col("reason") == "unexpected", last(F.element_at("b_ord", -1) + _EXTRA)).when(F.col("reason") == "length", last(F.lit(_LENGTH))).otherwise(F.col("a_ord"))
    length = F.col("reason") == "length"
    value = lambda s: F.when(length, F.col(f"{s}_size").cast("string")).otherwise(F.col(f"{s}_value"))
    path = F.concat("path", F.when(length, ".length").otherwise(""))
    return found.select("key", order.alias("ord"), path.alias("path"), value("a").alias("expected"), value("b").alias("actual"), F.col("a_type").alias("expected_type"), F.col("b_type").alias("actual_type"), "reason")


def differences(expected: DataFrame, actual: DataFrame, key: str = "sequence", fields: list[str] | None = None) -> DataFrame:
    """All differing fields of two logs: key, ord, field (path below the row), expected, actual, both types, reason.

    Columns may be nested; types and columns that only one side has differ like keys of documents. A row that only one side has is missing or unexpected.
    """
    rows = differing_rows(document(expected, key, fields), document(actual, key, fields and [c for c in fields if c in actual.columns]))
    return _all_differences(rows).withColumnsRenamed({"key": key, "path": "field"}).withColumn("field", F.regexp_replace("field", r"^\.", ""))


def _all_differences(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    lonely = rows.where("expected is null or actual is null").select("key", F.array().cast("array<int>").alias("ord"), F.lit("").alias("path"), none.alias("expected"), none.alias("actual"), none.alias("expected_type"), none.alias("actual_type"), F.when(F.col("actual").isNull(), "missing").otherwise("unexpected").alias("reason"))
    return lonely.unionByName(document_differences(rows)).select(*_DIFFS)


def first_difference(rows: DataFrame, root: str = "$.trades") -> DataFrame:
    """One row, or none if the logs are equal: path, expected, actual, both types, reason of the earliest difference between rows as differing_rows gives them.

    Only the documents of the first differing key are taken apart. Rows that one side alone has are a difference of length, which comes after all others.
    """
    shared = rows.where("expected is not null and actual is not null")
    head = shared.agg(F.min_by(F.struct("key", "expected", "actual"), "key").alias("x")).where("x is not null").select("x.*")
    row = F.struct(*_DIFFS)
    first = document_differences(head).agg(F.min_by(row, "ord").alias("x")).where("x is not null").select("x.*")
    out = first.select(F.concat(F.lit(f"{root}["), F.col("key").cast("string"), F.lit("]"), "path").alias("path"), *_DIFFS[3:])
    only = lambda c: F.count_if(F.col(c).isNotNull())
    lonely = rows.where("expected is null or actual is null").agg(F.min("key").alias("key"), only("expected").alias("e"), only("actual").alias("a")).where("key is not null")
    # where keys count up from 0, the shorter side ends at the first key that it lacks
    short = F.col("key").cast("string")
    length = lonely.select(F.lit(f"{root}.length").alias("path"), F.when(F.col("e") > 0, (F.col("key") + F.col("e")).cast("string")).otherwise(short).alias("expected"), F.when(F.col("e") > 0, short).otherwise((F.col("key") + F.col("a")).cast("string")).alias("actual"), F.lit("int").alias("expected_type"), F.lit("int").alias("actual_type"), F.lit("length").alias("reason"))
    ranked = out.withColumn("_no", F.lit(0)).unionByName(length.withColumn("_no", F.lit(1)))
    return ranked.agg(F.min_by(F.struct(*ranked.columns), "_no").alias("x")).where("x is not null").select("x.*").drop("_no")


def _compared(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """The differing documents of two logs, stored: every report asks them several times."""
    return stored(differing_rows(document(expected, key), document(actual, key)), "differing")


def surface_diff(expected: DataFrame, actual: DataFrame, key: str = "sequence", root: str = "$.trades") -> DataFrame:
    """First difference of two trade logs by position, at any depth: path, expected, actual, expected_type, actual_type, reason."""
    return first_difference(_compared(expected, actual, key), root)


#: What stands before an event's state, in the order of comparison.
EVENT_KEY = ["sequence", "ts", "phase", "pair", "callback"]


def trace_diff(a: DataFrame, b: DataFrame, header_a: dict | None = None, header_b: dict | None = None) -> DataFrame:
    """First difference of two event streams: sequence, path, expected, actual, reason; no row if there is none.

    Headers, if given, come first ($.header.<field>), then at each event its key ($.event_key.<field>), the fields of its state, a JSON document ($.state...), and its
    hash ($.event_hash), which alone decides whether the state is looked at; last the number of events ($.events.length). Streams without state compare by hash.
    """
    spark = a.sparkSession
    if header_a is not None and header_b is not None:
        off = [(None, f"$.header.{f}", str(v), None if header_b.get(f) is None else str(header_b[f]), "header") for f, v in header_a.items() if header_b.get(f) != v]
        if off:
            return spark.createDataFrame(off[:1], "sequence long, path string, expected string, actual string, reason string")
    at = lambda df: df.withColumn("_key", F.to_json(F.struct(*EVENT_KEY), {"ignoreNullFields": "false"})).select(F.col("sequence").cast("long").alias("key"), "_key", "event_hash", *([c for c in ["state"] if c in df.columns]))
    x, y = at(a), at(b)
    has_state = "state" in x.columns and "state" in y.columns
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{s}{c}") for c in df.columns if c != "key"])
    marks = side(x.drop("state"), "a").join(side(y.drop("state"), "b"), "key", "full_outer").where("not (a_key <=> b_key and aevent_hash <=> bevent_hash)")
    marks = stored(marks, "events")
    first = marks.where("a_key is not null and b_key is not null").agg(F.min_by(F.struct("*"), "key").alias("x")).where("x is not null").select("x.*")
    keys = document_differences(first.select("key", F.col("a_key").alias("expected"), F.col("b_key").alias("actual"))).withColumn("path", F.concat(F.lit("$.event_key"), "path")).withColumn("_no", F.lit(0))
    found = keys
    if has_state:
        one = F.broadcast(first.select("key"))  # one row
        states = x.join(one, "key").select("key", F.col("state").alias("expected")).join(y.join(one, "key").select("key", F.col("state").alias("actual")), "key")
        found = found.unionByName(document_differences(states).withColumn("path", F.concat(F.lit("$.state"), "path")).withColumn("_no", F.lit(1)))
    none = F.array().cast("array<int>")
    hashes = first.where("not (aevent_hash <=> bevent_hash)").select("key", none.alias("ord"), F.lit("$.event_hash").alias("path"), F.col("aevent_hash").alias("expected"), F.col("bevent_hash").alias("actual"), F.lit("str").alias("expected_type"), F.lit("str").alias("actual_type"), F.lit("value").alias("reason"), F.lit(2).alias("_no"))
    lonely = marks.where("a_key is null or b_key is null").agg(F.min("key").alias("key"), F.count("a_key").alias("e"), F.count("b_key").alias("n")).where("key is not null")
    ends = lambda c, other: F.when(F.col(c) > 0, F.col("key") + F.col(c)).otherwise(F.col("key")).cast("string")
    length = lonely.select("key", none.alias("ord"), F.lit("$.events.length").alias("path"), ends("e", "n").alias("expected"), ends("n", "e").alias("actual"), F.lit("int").alias("expected_type"), F.lit("int").alias("actual_type"), F.lit("length").alias("reason"), F.lit(3).alias("_no"))
    every = found.unionByName(hashes).unionByName(length)
    best = every.agg(F.min_by(F.struct("key", "path", "expected", "actual", "reason"), F.struct("_no", "ord")).alias("x")).where("x is not null").select("x.*")
    return best.withColumnRenamed("key", "sequence")


def fragment(a: DataFrame, b: DataFrame, index: int, key: str = "sequence") -> DataFrame:
    """The row at an index from both sides."""
    x, y = a.where(F.col(key) == index).withColumn("side", F.lit("expected")), b.where(F.col(key) == index).withColumn("side", F.lit("actual"))
    return x.unionByName(y)


def _confirmed(expected: DataFrame, actual: DataFrame, rows: DataFrame) -> DataFrame:
    first = first_difference(rows)
    sizes = expected.agg(F.count("*").alias("expected_rows")).crossJoin(actual.agg(F.count("*").alias("actual_rows")))  # one row each
    counted = rows.agg(F.count("*").alias("differing_rows"))
    return sizes.crossJoin(counted).join(first, F.lit(True), "left").withColumn("equal", F.col("differing_rows") == 0)


def confirmation_report(expected: DataFrame, actual: DataFrame, key: str = "sequence") -> DataFrame:
    """One row: rows of both sides, how many differ, the first difference (path, values, types, reason) and whether they are equal."""
    return _confirmed(expected, actual, _compared(expected, actual, key))


def mismatch_report(expected: DataFrame, actual: DataFrame, candles: DataFrame, key: str = "sequence", state_difference: DataFrame | None = None) -> DataFrame:
    """Confirmation report with the replay: candles and pairs up to the cutoff, and both sides' fragments of the trade that differs first.

    The cutoff is the time of the first differing state event (ts), if given; else the later close of the two trades that differ first; else the last candle. Fragments are
    the trades as JSON, {"missing":true} for a side that has none, null if nothing differs. Trades need close_ts.
    """
    rows = _compared(expected, actual, key)
    # a missing row is the first difference only if no row of both sides differs
    first = rows.agg(F.min_by(F.struct("key", "expected", "actual"), F.struct(F.col("expected").isNull() | F.col("actual").isNull(), "key")).alias("x")).select("x.*")
    gone = F.when(F.col("key").isNotNull(), F.lit('{"missing":true}'))
    first = F.broadcast(first.select(F.col("key").alias("_at"), F.coalesce("expected", gone).alias("expected_fragment"), F.coalesce("actual", gone).alias("actual_fragment")))  # one row
    ends = expected.select(key, "close_ts").unionByName(actual.select(key, "close_ts")).join(first, F.col(key) == F.col("_at")).agg(F.max("close_ts").alias("_trade"))
    event = state_difference.agg(F.min("ts").alias("_event")) if state_difference is not None else candles.sparkSession.range(1).select(F.lit(None).cast("long").alias("_event"))
    last = candles.agg(F.max("ts").alias("_last"))
    cutoff = F.broadcast(ends.crossJoin(event).crossJoin(last).select(F.coalesce("_event", "_trade", "_last").alias("cutoff")))  # one row
    kept = candles.join(cutoff, F.col("ts") <= F.col("cutoff")).agg(F.count("*").alias("replay_candles"), F.count_distinct("pair").alias("replay_pairs"))
    return _confirmed(expected, actual, rows).crossJoin(cutoff).crossJoin(kept).crossJoin(first.drop("_at"))


def validate_surface(trades: DataFrame, decimals: list[str]) -> DataFrame:
    """Rows that break a rule: sequence is not the index, a decimal text is not canonical, or the close is before the open.

    The index is the number of smaller sequences, counted in two levels over blocks of sequences. What the rules need of a row is stored once, without its texts.
    """
    odd = F.lit(False)
    for c in decimals:
        odd = odd | ~canonical_decimal(F.col(c)).eqNullSafe(F.col(c))
    trades = stored(trades.select("sequence", F.when(odd, "decimal").when(F.col("close_ts") < F.col("open_ts"), "time").alias("_code")), "checked", "zstd")
    block = F.floor(F.col("sequence") / 100_000)
    rows = trades.withColumn("_b", block).withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("sequence")))
    before = trades.groupBy(block.alias("_b")).agg(F.count("*").alias("_c")).withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    code = F.when(F.col("_n") + F.col("_o") - 1 != F.col("sequence"), "sequence").otherwise(F.col("_code"))
    return rows.join(before.select("_b", "_o"), "_b").withColumn("code", code).where("code is not null").select("sequence", "code")


def event_hash(state_json: Column, header: list[Column]) -> Column:
    """SHA-256 of an event: its header fields and the hash of its state."""
    return F.sha2(F.concat_ws("\n", *[h.cast("string") for h in header], F.sha2(state_json, 256)), 256)


def hashed_events(events: DataFrame) -> DataFrame:
    """Adds state_hash and event_hash. Events: sequence, ts, phase, pair, callback, state (JSON text with sorted names)."""
    head = [F.col(c) for c in ("sequence", "ts", "phase", "pair", "callback")]
    return events.withColumn("state_hash", F.sha2("state", 256)).withColumn("event_hash", event_hash(F.col("state"), head))


def validate_events(events: DataFrame, expected_count: int | None = None) -> DataFrame:
    """First event that breaks a rule: sequence contiguous from 0, time not negative, phase given, hashes right; a wrong number of events is reported after the last."""
    head = [F.col(c) for c in ("sequence", "ts", "phase", "pair", "callback")]
    block = F.floor(F.col("sequence") / 100_000)
    rows = events.withColumn("_n", F.row_number().over(Window.partitionBy(block).orderBy("sequence")) - 1 + block * 100_000)
    code = F.when(F.col("_n") != F.col("sequence"), "sequence").when(F.col("ts") < 0, "time").when(F.coalesce("phase", F.lit("")) == "", "phase")
    code = code.when(F.sha2("state", 256) != F.col("state_hash"), "state_hash").when(event_hash(F.col("state"), head) != F.col("event_hash"), "event_hash")
    bad = rows.withColumn("code", code).where("code is not null").select("sequence", "code")
    if expected_count is not None:
        bad = bad.unionByName(events.agg(F.count("*").alias("sequence")).where(F.col("sequence") != expected_count).withColumn("code", F.lit("count")))
    return bad.agg(F.min_by(F.struct("sequence", "code"), "sequence").alias("x")).where("x is not null").select("x.*")


def trace_digest(events: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row: events and the digest of the stream: SHA-256 over the ordered digests of chunks of `chunk` event hashes."""
    part = events.withColumn("_c", F.floor(F.col("sequence") / chunk)).groupBy("_c")
    chunks = part.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "event_hash"))), lambda x: x["event_hash"]), "\n"), 256).alias("d"))
    return chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))
