"""String commands over tables of (key, stored) and over an ordered command log.

A log has columns seq (unique order), ts, cmd, key, value and, for expiry, ttl
in seconds (of psetex in milliseconds).  Values are plain or stored; commands that only move values work on
either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikv.operators.ordered import carry_last
from lexikv.workspace import settle

WRITES = ("set", "setex", "psetex", "getset")
DELETES = ("getdel", "del")


def _expires() -> Column:
    """When a command's time to live ends; null: never."""
    return F.col("ts") + F.make_dt_interval(secs=F.col("ttl") / F.when(F.col("cmd") == "psetex", 1000).otherwise(1))


def expiry(at: Column, n: Column, unit: Column) -> Column:
    """When a time to live of ``n`` ends: EX (seconds) and PX (milliseconds) from ``at``, EXAT and PXAT from 1970; null for other units."""
    unit, epoch = F.upper(unit), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds, millis = F.make_dt_interval(secs=n), F.make_dt_interval(secs=n / 1000)
    return F.when(unit == "EX", at + seconds).when(unit == "PX", at + millis).when(unit == "EXAT", epoch + seconds).when(unit == "PXAT", epoch + millis)


def live(expire_at: Column, now: Column) -> Column:
    return expire_at.isNull() | (expire_at > now)


def get(requests: DataFrame, store: DataFrame, value: str = "value") -> DataFrame:
    """``requests`` with the key's value, null where it has none.  Keys are unique in ``store``."""
    return requests.join(store.select("key", value), "key", "left")


def mget(requests: DataFrame, store: DataFrame, value: str = "value", empty_is_null: bool = False) -> DataFrame:
    """(request, values): each request's values in the order of its ``keys`` array, null where missing."""
    asked = requests.select("request", F.posexplode_outer("keys").alias("pos", "key"))
    found = F.when(F.octet_length(value) > 0, F.col(value)) if empty_is_null else F.col(value)
    held = asked.join(store.select("key", found.alias("v")), "key", "left")
    # the struct keeps nulls in place
    ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "v"))))
    return held.groupBy("request").agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def mset(pairs: DataFrame) -> DataFrame:
    """(key, value) after writes (request, pos, key, value): the last of each key."""
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("request", "pos")).alias("value"))


def msetnx(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs (request, key, ...) that are written, requests in order: one of which a key exists already writes nothing.

    A key also exists once an earlier request wrote it.  Each round settles the
    requests that are first in line for all their keys, and those that a
    written key refuses; rounds are as many as the longest chain of requests
    that wait for each other.
    """
    waiting = settle(pairs.select("request", "key").distinct(), "msetnx-waiting")
    there, written = store.select("key"), None
    while True:
        refused = waiting.join(there, "key", "left_semi").select("request").distinct()
        left = settle(waiting.join(refused, "request", "left_anti"), "msetnx-left")
        if left.isEmpty():
            break
        first = left.groupBy("key").agg(F.min("request").alias("first"))
        behind = left.join(first, "key").filter("request > first").select("request").distinct()
        now = settle(left.join(behind, "request", "left_anti"), "msetnx-written")
        done = now.select("request").distinct()
        written = done if written is None else written.unionAll(done)
        there, waiting = now.select("key"), left.join(done, "request", "left_anti")
    return pairs.limit(0) if written is None else pairs.join(written, "request", "left_semi")


def last_write(log: DataFrame) -> DataFrame:
    """(key, value, seq) of each key's last plain write, ignoring deletes; one combining aggregate."""
    return log.filter(F.col("cmd").isin(*WRITES)).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def _last_life(log: DataFrame, renewals: bool = False) -> DataFrame:
    """(key, value, expire_at) of keys that hold a value after the whole log.

    ``expire_at`` is that of the plain write the value began with; one begun by setnx or append has none.  With
    ``renewals``, the last getex on the value replaces it; a getex on a key without a value changes nothing.
    """
    opened = F.struct("seq", F.when(F.col("cmd").isin(*WRITES), F.struct("value", _expires().alias("expire_at"))).alias("held"))
    lives = log.filter(F.col("cmd").isin(*WRITES, *DELETES)).groupBy("key").agg(F.max_by(opened, "seq").alias("_life"))
    began = lives.select(F.col("key").alias("_key"), F.col("_life.seq").alias("_began"))
    later = log.filter(F.col("cmd").isin("setnx", "append", *(["getex"] if renewals else []))).join(began, F.col("key").eqNullSafe(F.col("_key")), "left").filter("_began is null or seq > _began")
    chunks = F.array_sort(F.collect_list(F.when(F.col("cmd") == "append", F.struct("seq", F.coalesce("value", F.lit("")).alias("value")))))
    is_getex = F.col("cmd") == "getex"
    first = F.min_by(F.when(~is_getex, F.struct("cmd", "value", "seq")), F.when(~is_getex, F.col("seq")))
    renewal = F.max_by(F.when(is_getex, F.struct("seq", _expires().alias("expire_at"))), F.when(is_getex, F.col("seq")))
    text = F.array_join(F.transform(chunks, lambda x: x["value"]), "")
    added = later.groupBy(F.col("key").alias("_key")).agg(first.alias("_first"), renewal.alias("_renewal"), text.alias("_text"))
    both = lives.join(added, F.col("key").eqNullSafe(F.col("_key")), "full")
    # without a value, the first setnx or append gives one; appends add to it
    opener = F.coalesce("_life.held.value", F.when(F.col("_first.cmd") == "setnx", F.coalesce("_first.value", F.lit(""))), F.when(F.col("_first").isNotNull(), F.lit("")))
    written = F.col("_life.held.value").isNotNull()
    renewed = F.col("_renewal").isNotNull() & (written | (F.col("_renewal.seq") > F.col("_first.seq")))
    expire_at = F.when(renewed, F.col("_renewal.expire_at")).when(written, F.col("_life.held.expire_at"))
    out = both.select(F.coalesce("key", "_key").alias("key"), F.concat(opener, F.coalesce("_text", F.lit(""))).alias("value"), expire_at.alias("expire_at"))
    return out.filter("value is not null")


def final_state(log: DataFrame) -> DataFrame:
    """(key, value) of keys that hold a value after all their commands."""
    return _last_life(log).select("key", "value")


def _before(log: DataFrame, chunk: int = 65_536) -> DataFrame:
    """``log`` with ``before``: the key's value before each command, null where it has none.

    A life lasts from one plain write or delete up to the next.  It holds the
    value of the write, or else of the first setnx or append, and what was
    appended since.  A window sees ``chunk`` sequence numbers of a life at
    most, as in ``carry_last``.
    """
    reset = F.when(F.col("cmd").isin(*WRITES, *DELETES), F.struct("seq", F.when(F.col("cmd").isin(*WRITES), F.col("value")).alias("value")))
    rows = carry_last(log, "key", "seq", reset, "_life", chunk=chunk).withColumn("_from", F.coalesce("_life.seq", F.lit(-1))).withColumn("_chunk", F.floor(F.col("seq") / chunk))
    first = F.when(F.col("cmd").isin("setnx", "append"), F.struct(F.when(F.col("cmd") == "setnx", F.col("value")).alias("value")))
    rows = rows.withColumn("_nx", first).withColumn("_add", F.when(F.col("cmd") == "append", F.col("value")))
    adds = F.array_sort(F.collect_list(F.when(F.col("_add").isNotNull(), F.struct("seq", "_add"))))
    ends = rows.groupBy("key", "_from", "_chunk").agg(
        F.min_by("_nx", F.when(F.col("_nx").isNotNull(), F.col("seq"))).alias("_first"), F.array_join(F.transform(adds, lambda x: x["_add"]), "").alias("_adds")
    )
    earlier = Window.partitionBy("key", "_from").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("key").alias("_key"), F.col("_from").alias("_of"), F.col("_chunk").alias("_at"),
        F.first("_first", ignorenulls=True).over(earlier).alias("_first"), F.array_join(F.collect_list("_adds").over(earlier), "").alias("_adds"),
    )
    within = Window.partitionBy("key", "_from", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("_here", F.first("_nx", ignorenulls=True).over(within)).withColumn("_since", F.collect_list("_add").over(within))
    met = F.col("key").eqNullSafe(F.col("_key")) & (F.col("_from") == F.col("_of")) & (F.col("_chunk") == F.col("_at"))
    began = F.when(F.col("_life.value").isNotNull(), F.struct(F.col("_life.value").alias("value"))).otherwise(F.coalesce("_first", "_here"))
    text = F.concat(F.coalesce(began["value"], F.lit("")), F.coalesce("_adds", F.lit("")), F.array_join("_since", ""))
    return here.join(carried, met, "left").select(*log.columns, F.when(began.isNotNull(), text).alias("before"))


def replay(log: DataFrame) -> DataFrame:
    """``log`` with ``before`` and ``after``: the key's value around each command, null where it has none.

    Knows set, setex, psetex, getset, setnx, append, getdel, del and reads.
    """
    value = F.coalesce("value", F.lit(""))
    after = (
        F.when(F.col("cmd").isin(*WRITES), F.col("value"))
        .when(F.col("cmd") == "setnx", F.coalesce("before", value))
        .when(F.col("cmd") == "append", F.concat(F.coalesce("before", F.lit("")), value))
        .when(~F.col("cmd").isin(*DELETES), F.col("before"))
    )
    return _before(log).withColumn("after", after)


def setnx_replies(log: DataFrame) -> DataFrame:
    """(seq, key, reply) of each setnx: 1 where the key had no value."""
    adds = F.col("cmd").isin("setnx", "append") | (F.col("cmd").isin(*WRITES) & F.col("value").isNotNull())
    held = F.when(adds, F.lit(True)).when(F.col("cmd").isin(*WRITES, *DELETES), F.lit(False))
    rows = carry_last(log, "key", "seq", held, "_held").filter("cmd = 'setnx'")
    return rows.select("seq", "key", F.when(F.col("_held"), 0).otherwise(1).alias("reply"))


def get_as_of(log: DataFrame) -> DataFrame:
    """(seq, key, value) of each get: what the commands before it left, or null."""
    return _before(log).filter("cmd = 'get'").select("seq", "key", F.col("before").alias("value"))


def getset_previous(log: DataFrame) -> DataFrame:
    """(seq, key, previous, value) of each plain write: what the commands before it left."""
    return _before(log).filter(F.col("cmd").isin(*WRITES)).select("seq", "key", F.col("before").alias("previous"), "value")


def getdel_replies(log: DataFrame) -> DataFrame:
    """(seq, key, value) of each getdel: the value it takes away."""
    return _before(log).filter("cmd = 'getdel'").select("seq", "key", F.col("before").alias("value"))


def append_fold(log: DataFrame) -> DataFrame:
    """(key, value, length) of all chunks appended to each key, in order."""
    chunks = log.filter("cmd = 'append'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("c"))
    value = F.array_join(F.transform("c", lambda x: F.coalesce(x["value"], F.lit(""))), "")
    return chunks.select("key", value.alias("value"), F.octet_length(value).cast("long").alias("length"))


def ttl_live(log: DataFrame, now: Column, renewals: bool = False) -> DataFrame:
    """(key, value, expire_at) of keys that hold a value after all their commands, not expired at ``now``; expire_at null: never.

    Expiry is judged at ``now`` only, not between commands (as in ``replay``); getex is looked at with ``renewals`` only.
    """
    return _last_life(log, renewals).filter(live(F.col("expire_at"), now))


def getex(log: DataFrame) -> DataFrame:
    """``log`` with expire_at after each command.

    Writes, and getex, set it (ttl null: never, as PERSIST); deletes clear it;
    other rows keep it.
    """
    sets = F.when(F.col("cmd").isin(*WRITES, "getex"), F.struct(_expires().alias("at"))).when(F.col("cmd").isin(*DELETES), F.struct(F.lit(None).cast("timestamp").alias("at")))
    return carry_last(log, "key", "seq", sets, "_at", inclusive=True).select(*log.columns, F.col("_at.at").alias("expire_at"))


def options(log: DataFrame) -> DataFrame:
    """``log`` with ``written`` and ``expire_at``: whether each plain write took effect, and the key's expiry after each command.

    Rows also have ``cond`` and ``unit`` (any case, null: none).  A set with NX
    writes only where the key has no value, with XX only where it has one.
    EX, PX, EXAT and PXAT say what ``ttl`` is, for writes and getex.  A write
    without a unit ends the expiry, with KEEPTTL leaves it; a getex ends it
    with PERSIST and leaves it without a unit.  Keys aren't taken away by
    expiry between commands.
    """
    cmd, cond, unit = F.col("cmd"), F.coalesce(F.upper("cond"), F.lit("")), F.coalesce(F.upper("unit"), F.lit(""))
    writes, deletes = cmd.isin(*WRITES), cmd.isin(*DELETES)
    # a set with XX changes nothing about whether there is a value, and after one with NX there is
    there = F.when(cmd.isin("setnx", "append") | (writes & (cond != "XX")), F.lit(True)).when(deletes, F.lit(False))
    held = F.coalesce("_there", F.lit(False))
    rows = carry_last(log, "key", "seq", there, "_there").withColumn("written", writes & ~((cond == "NX") & held) & ~((cond == "XX") & ~held))
    timed = (F.col("written") & (unit != "KEEPTTL")) | ((cmd == "getex") & ~unit.isin("", "KEEPTTL"))
    at = F.struct(expiry(F.col("ts"), F.col("ttl"), F.col("unit")).alias("at"))
    sets = F.when(timed, at).when(deletes, F.struct(F.lit(None).cast(log.schema["ts"].dataType).alias("at")))
    return carry_last(rows, "key", "seq", sets, "_at", inclusive=True).select(*log.columns, "written", F.col("_at.at").alias("expire_at"))
