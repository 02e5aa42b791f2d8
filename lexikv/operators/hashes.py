"""Hash commands over (key, field, value) tables; fields are plain, values plain or stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikv.operators.strings import expiry


def _or_null(value: Column) -> Column:
    """Null for an empty value."""
    return F.when(F.octet_length(value) > 0, value)


def hget(requests: DataFrame, store: DataFrame) -> DataFrame:
    """``requests`` (key, field) with the value; null where missing or empty."""
    return requests.join(store.select("key", "field", _or_null(F.col("value")).alias("value")), ["key", "field"], "left")


def hmget(requests: DataFrame, store: DataFrame, empty_is_null: bool = False) -> DataFrame:
    """(request, values) in the order of each request's ``fields`` of its ``key``."""
    asked = requests.select("request", "key", F.posexplode_outer("fields").alias("pos", "field"))
    value = _or_null(F.col("value")) if empty_is_null else F.col("value")
    held = asked.join(store.select("key", "field", value.alias("v")), ["key", "field"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "v"))))
    return held.groupBy("request").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def hvals(store: DataFrame) -> DataFrame:
    """(key, values) in field order; empty values are null."""
    ordered = F.array_sort(F.collect_list(F.struct("field", _or_null(F.col("value")).alias("v"))))
    return store.groupBy("key").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def hgetall(store: DataFrame) -> DataFrame:
    """(key, entries): structs (field, value) in field order; empty values are null."""
    return store.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", _or_null(F.col("value")).alias("value")))).alias("entries"))


def hset(writes: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new store, replies) of writes (seq, key, field, value).

    The last write of a field wins; a reply (key, added) counts a key's fields
    that the store lacked.
    """
    last = writes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    merged = store.select("key", "field", "value").join(last.select("key", "field"), ["key", "field"], "left_anti").unionByName(last)
    marked = last.join(store.select("key", "field", F.lit(True).alias("_old")), ["key", "field"], "left")
    return merged, marked.groupBy("key").agg(F.count_if(F.col("_old").isNull()).alias("added"))


def hsetnx(writes: DataFrame, store: DataFrame) -> DataFrame:
    """``writes`` (seq, key, field, value) with reply 1 for the first of a field that the store lacks, else 0."""
    first = writes.groupBy("key", "field").agg(F.min("seq").alias("_first"))
    marked = writes.join(first, ["key", "field"]).join(store.select("key", "field", F.lit(True).alias("_old")), ["key", "field"], "left")
    return marked.withColumn("reply", (F.col("_old").isNull() & (F.col("seq") == F.col("_first"))).cast("int")).drop("_first", "_old")


def hgetdel(requests: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies, store without the fields asked for); an empty value is answered as null and goes."""
    return hget(requests, store), store.join(requests.select("key", "field"), ["key", "field"], "left_anti")


def hrandfield(store: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` fields of each key, chosen by a seeded hash; (key, field, value).

    A negative ``n`` draws that many times, each time from all fields of the
    key, so fields may repeat.
    """
    if n < 0:
        draws = store.select("key", "field", "value", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("_draw"))
        lot = F.md5(F.concat_ws(":", F.lit(str(seed)), "key", "_draw", "field").cast("binary"))
        picked = draws.groupBy("key", "_draw").agg(F.min_by(F.struct("field", "value"), F.struct(lot, "field")).alias("_picked"))
        return picked.select("key", "_picked.field", "_picked.value")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("field").cast("string")).cast("binary"))
    picked = store.withColumn("_order", order)
    return picked.withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("_order", "field"))).filter(F.col("_rank") <= n).select("key", "field", "value")


def hexpire(writes: DataFrame) -> DataFrame:
    """HSETEX and HGETEX: (key, field, expire_at) after the last command (seq, ts, ttl) of each field; ttl null: never."""
    at = F.col("ts") + F.make_dt_interval(secs=F.col("ttl"))
    return writes.groupBy("key", "field").agg(F.max_by(at, "seq").alias("expire_at"))


def _last_expiry(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """(key, field, ...) of the last request of each field in ``rows``."""
    return rows.groupBy("key", "field").agg(F.max_by(F.struct(*columns), "request").alias("_last")).select("key", "field", "_last.*")


def hsetex(writes: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new store, replies) of writes (request, ts, key, field, value, cond, unit, ttl) to a store (key, field, value, expire_at).

    ``cond`` FNX writes a request's fields only if the store has none of them,
    FXX only if it has all; the store counts as it was before these writes, and
    KEEPTTL leaves the expiry it had.  Units are those of ``strings.expiry``;
    none means no expiry.  A request names a field once; of several requests
    the last counts.  Replies are (request, reply): 1 for one that wrote.
    """
    old = store.select("key", "field", F.col("expire_at").alias("_until"), F.lit(True).alias("_old"))
    rows = writes.join(old, ["key", "field"], "left").withColumn("_old", F.coalesce("_old", F.lit(False)))
    cond = F.upper(F.max("cond"))
    goes = F.when(cond == "FNX", ~F.bool_or("_old")).when(cond == "FXX", F.bool_and("_old")).otherwise(True)
    replies = rows.groupBy("request").agg(goes.cast("int").alias("reply"))
    until = F.when(F.upper("unit") == "KEEPTTL", F.col("_until")).otherwise(expiry(F.col("ts"), F.col("ttl"), F.col("unit")))
    last = _last_expiry(rows.join(replies.filter("reply = 1"), "request"), "value", until.alias("expire_at"))
    rest = store.select("key", "field", "value", "expire_at").join(last.select("key", "field"), ["key", "field"], "left_anti")
    return rest.unionByName(last), replies


def hgetex(requests: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies, new store) of requests (request, ts, key, field, unit, ttl) to a store (key, field, value, expire_at).

    A reply is (request, key, field, value), the value null where missing or empty.  A unit sets the
    field's expiry, PERSIST ends it, none leaves it; of several that do the
    last counts.
    """
    set_by = requests.filter(F.col("unit").isNotNull())
    last = _last_expiry(set_by, expiry(F.col("ts"), F.col("ttl"), F.col("unit")).alias("_until"), F.lit(True).alias("_set"))
    until = F.when(F.col("_set"), F.col("_until")).otherwise(F.col("expire_at"))
    return hget(requests.select("request", "key", "field"), store), store.join(last, ["key", "field"], "left").select("key", "field", "value", until.alias("expire_at"))
