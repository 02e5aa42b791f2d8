"""Versions of dictionaries: ranking, retention, ids, reloads and garbage.

A registry has columns id, uuid, dict, namespaces (array), created, retired
(null while active), level, signature, dict_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikv.workspace import settle

SCHEMA = "id int, uuid string, dict binary, namespaces array<string>, created timestamp, retired timestamp, level int, signature string, dict_size long"
MAX_ID = 65535


def ranked(registry: DataFrame) -> DataFrame:
    """A row for each (ns, active dictionary) with its rank: newest first, then the higher id, then the later uuid."""
    spread = registry.filter(F.col("retired").isNull()).withColumn("ns", F.explode(F.when(F.size("namespaces") > 0, F.col("namespaces")).otherwise(F.array(F.lit("default")))))
    return spread.drop("namespaces").withColumn("rank", F.row_number().over(Window.partitionBy("ns").orderBy(F.desc("created"), F.desc("id"), F.desc("uuid"))))


def active(registry: DataFrame) -> DataFrame:
    """(ns, dict_id, dict_size, total_dicts): each namespace's newest dictionary."""
    newest = F.struct("created", "id", "dict_size")
    spread = registry.filter(F.col("retired").isNull()).select(F.explode(F.when(F.size("namespaces") > 0, F.col("namespaces")).otherwise(F.array(F.lit("default")))).alias("ns"), "id", "created", F.coalesce("dict_size", F.lit(0)).alias("dict_size"))
    return spread.groupBy("ns").agg(F.max(newest).alias("m"), F.count("*").alias("total_dicts")).select("ns", F.col("m.id").alias("dict_id"), F.col("m.dict_size").alias("dict_size"), "total_dicts")


def overflow(registry: DataFrame, keep: int) -> DataFrame:
    """Ids to retire: those beyond the newest ``keep`` of every namespace they serve."""
    return ranked(registry).groupBy("id").agg(F.min((F.col("rank") > keep).cast("int")).alias("over")).filter("over = 1").select("id")


def retire(registry: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Set ``retired`` once; id 0 and already retired rows stay as they are."""
    marked = registry.join(ids.select("id").distinct().withColumn("_go", F.lit(True)), "id", "left")
    return marked.withColumn("retired", F.when(F.col("_go") & F.col("retired").isNull() & (F.col("id") != 0), now).otherwise(F.col("retired"))).select(registry.columns)


def next_ids(registry: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest free ids (k, id), from 1; retired dictionaries that are still listed hold theirs."""
    free = registry.sparkSession.range(1, MAX_ID + 1).select(F.col("id").cast("int").alias("id")).join(registry.select("id").filter("id is not null").distinct(), "id", "left_anti")
    return free.orderBy("id").limit(n).select(F.row_number().over(Window.orderBy("id")).alias("k"), "id")  # one of 65535 ids at most


def assign_ids(registry: DataFrame, waiting: bool = False) -> DataFrame:
    """Give rows without an id, oldest first, the lowest free ids.

    If there are more rows than free ids, raises ValueError or, with
    ``waiting``, leaves the newest rows without one.
    """
    taken = registry.agg(F.count_if(F.col("id").isNull()).alias("new"), F.countDistinct(F.when(F.col("id").between(1, MAX_ID), F.col("id"))).alias("held")).first()
    free = MAX_ID - taken["held"]
    over = taken["new"] > free
    if over and not waiting:
        raise ValueError(f"{taken['new']} dictionaries want an id; {free} are free")
    new = registry.filter(F.col("id").isNull())
    served = settle(new.orderBy("created", "uuid").limit(free), "served") if over else new
    served_k = served.withColumn("k", F.row_number().over(Window.orderBy("created", "uuid")))  # 65535 rows at most
    numbered = served_k.drop("id").join(next_ids(registry, MAX_ID), "k").select(registry.columns)
    out = registry.filter(F.col("id").isNotNull()).unionByName(numbered)
    return out.unionByName(new.exceptAll(served)) if over else out


def by_id(registry: DataFrame) -> DataFrame:
    """One row for each id: the newest."""
    rest = [c for c in registry.columns if c != "id"]
    return registry.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("created", "uuid")).alias("r")).select("id", "r.*").select(registry.columns)


def reload_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: namespaces, loaded, new, reused, retired (by presence of the id), failed (rows without content)."""
    before, after = old.select("id").distinct().withColumn("_old", F.lit(1)), new.select("id", F.col("dict").isNull().alias("_bad")).withColumn("_new", F.lit(1))
    spaces = new.select(F.explode("namespaces").alias("ns")).agg(F.countDistinct("ns").alias("namespaces"))
    both = before.join(after, "id", "full")
    counts = both.agg(
        F.count("_new").alias("loaded"), F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("reused"),
        F.count_if(F.col("_new").isNull()).alias("retired"), F.count_if(F.coalesce("_bad", F.lit(False))).alias("failed"),
    )
    return spaces.join(counts, how="inner", on=F.lit(True))


def garbage(registry: DataFrame, now: Column, quarantine_seconds: int, in_use: DataFrame | None = None) -> DataFrame:
    """Rows whose quarantine is over and whose id ``in_use`` lacks."""
    over = registry.filter(F.col("retired").isNotNull() & (F.col("retired") + F.make_dt_interval(secs=F.lit(quarantine_seconds)) <= now))
    return over if in_use is None else over.join(in_use.select("id").distinct(), "id", "left_anti")


def decodable(registry: DataFrame, now: Column, quarantine_seconds: int) -> DataFrame:
    """Active dictionaries and those in quarantine: values written with either still decode."""
    return registry.join(garbage(registry, now, quarantine_seconds).select("id"), "id", "left_anti")


def publish(registry: DataFrame, added: DataFrame, waiting: bool = False) -> DataFrame:
    """The next generation: the registry and new rows, which get free ids; ``waiting`` as in ``assign_ids``."""
    return assign_ids(registry.unionByName(added), waiting)


def signed(registry: DataFrame) -> DataFrame:
    return registry.withColumn("signature", F.sha2("dict", 256))


def signature_holds(registry: DataFrame) -> DataFrame:
    return registry.withColumn("valid", F.col("signature").isNull() | (F.col("signature") == F.sha2("dict", 256)))


def load(registry: DataFrame) -> dict[int, bytes]:
    """Dictionaries by id, for a ``Codec``, which bounds their size."""
    from lexikv.operators.codec import MAX_DICTIONARY_BYTES

    size = registry.agg(F.coalesce(F.sum(F.octet_length("dict")), F.lit(0))).first()[0]
    if size > MAX_DICTIONARY_BYTES:
        raise ValueError(f"{size} bytes of dictionaries; at most {MAX_DICTIONARY_BYTES}")
    return {r["id"]: bytes(r["dict"]) for r in by_id(registry).select("id", "dict").filter("dict is not null and id > 0").collect()}
