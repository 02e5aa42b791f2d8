"""Manifest files (``*.mf``): ``key = value`` lines that describe a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexikv.functions.parse import base_name, join_names, split_names, time_of, time_text, without_extension

from lexikv.operators.registry import SCHEMA


def parse_manifests(texts: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """(path, id, dict_file, namespaces, created, level, signature, retired, valid) of whole manifest texts.

    Keys match in any case; unknown ones and comments are passed over; no
    namespaces means ``default``.  A manifest with an unreadable id or time
    isn't valid.
    """
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.split(x, "#", 2)[0])), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split(x, "=", 2)[0])).alias("k"), F.trim(F.split(x, "=", 2)[1]).alias("v")))
    rows = texts.select(F.col(path).alias("path"), pairs.alias("_p"))

    def value(key: str) -> Column:  # the last one counts
        return F.when(F.size("_p") > 0, F.try_element_at(F.transform(F.filter("_p", lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1)))

    raw = rows.select("path", *(value(k).alias(k) for k in ("id", "dict_file", "namespaces", "created", "level", "signature", "retired")))
    names = split_names(F.col("namespaces"))
    id, created, retired = F.col("id").try_cast("int"), time_of(F.col("created")), time_of(F.col("retired"))
    time_ok = (F.col("created").isNull() | created.isNotNull()) & (F.col("retired").isNull() | (F.col("retired") == "") | retired.isNotNull())
    return raw.select(
        "path", id.alias("id"), "dict_file", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("default"))).alias("namespaces"), created.alias("created"),
        F.col("level").try_cast("int").alias("level"), "signature", retired.alias("retired"), (F.coalesce(id.between(0, 65535), F.col("id").isNull()) & time_ok).alias("valid"),
    )


def render_manifest() -> Column:
    """The text of a registry row's manifest."""
    line = lambda key, value: F.concat(F.lit(f"{key} = "), value)
    return F.concat(
        F.concat_ws(
            "\n", line("id", F.col("id").cast("string")), line("dict_file", F.concat("uuid", F.lit(".dict"))), line("namespaces", join_names(F.col("namespaces"))), line("created", time_text(F.col("created"))),
            line("level", F.col("level").cast("string")), line("signature", F.col("signature")), line("retired", time_text(F.col("retired"))),
        ),
        F.lit("\n"),
    )


def read_registry(spark: SparkSession, directory: str) -> DataFrame:
    """The registry of a directory of manifests and dictionary files; hidden and unreadable manifests are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*.mf").load(directory).select("path", F.col("content").cast("string").alias("value"))
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*.dict").load(directory).select(base_name(F.col("path")).alias("file"), F.col("content").alias("dict"), F.col("length").alias("dict_size"))
    return _registry_of(files, blobs)


def _registry_of(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """Registry rows of manifests (path, value) whose dictionary file is among ``blobs`` (file, dict, dict_size)."""
    found = parse_manifests(manifests).filter("valid").withColumn("file", base_name(F.col("dict_file")))
    return found.join(blobs, "file").select("id", without_extension(F.col("file")).alias("uuid"), "dict", "namespaces", "created", "retired", "level", "signature", "dict_size")


def load_published(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies, registry) of a replica's commands (seq, cmd, base, data): lm brings a manifest, ld a dictionary.

    A base name is refused if it is null or empty or could leave the
    dictionaries' directory: with a slash, a backslash, a zero byte or a dot in
    front.  Null data is refused too.  Of commands for one file the last
    counts.  Replies are (seq, reply); the registry has manifests that are
    valid and whose dictionary has come.
    """
    bad = F.coalesce(F.col("base").rlike(r"^\.|[/\\\x00]") | (F.col("base") == ""), F.lit(True))
    reply = F.when(bad, "ERR base name").when(F.col("data").isNull(), "ERR no data").otherwise("OK")
    judged = commands.filter(F.col("cmd").isin("lm", "ld")).withColumn("reply", reply)
    files = judged.filter("reply = 'OK'").groupBy("cmd", "base").agg(F.max_by("data", "seq").alias("data"))
    manifests = files.filter("cmd = 'lm'").select(F.concat("base", F.lit(".mf")).alias("path"), F.col("data").cast("string").alias("value"))
    data = F.col("data").cast("binary")
    blobs = files.filter("cmd = 'ld'").select(F.concat("base", F.lit(".dict")).alias("file"), data.alias("dict"), F.octet_length(data).cast("long").alias("dict_size"))
    return judged.select("seq", "reply"), _registry_of(manifests, blobs)


def save_registry(registry: DataFrame, directory: str) -> None:
    """Write the registry as a new generation below ``directory``, a Parquet table.

    A marker file, written last, makes it the current one, so a reader sees the
    old generation or the new one, whole.  Old generations stay for readers
    that began with them.
    """
    spark = registry.sparkSession
    path = f"{directory.rstrip('/')}/gen-{_generation(spark, directory) + 1:09d}"
    registry.write.mode("overwrite").parquet(path)  # of an attempt that left no marker, if any
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")


def _generation(spark: SparkSession, directory: str) -> int:
    """The newest marked generation; 0 for none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return 0
    names = [f.getPath().getName() for f in system.listStatus(root)]
    done = [int(n[4:13]) for n in names if n.startswith("gen-") and n.endswith(".done") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{n}/_SUCCESS"))]
    return max(done, default=0)


def saved_registry(spark: SparkSession, directory: str) -> tuple[int, DataFrame]:
    """The current generation that ``save_registry`` wrote: its number and rows.  Raises ValueError where there is none."""
    number = _generation(spark, directory)
    if not number:
        raise ValueError(f"{directory} holds no saved registry")
    return number, spark.read.schema(SCHEMA).parquet(f"{directory.rstrip('/')}/gen-{number:09d}")
