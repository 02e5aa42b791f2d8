"""What executors hold beside the heap: Python workers and the buffers of Parquet pages."""

from pyspark.sql import functions as F

from lexikv.llm import decontaminate
from lexikv.workspace import settle


def _tables(spark):
    docs = spark.createDataFrame([(i, f"w{i} " + " ".join(f"x{j}" for j in range(12)) if i % 3 else f"none {i}") for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(f"x{j}" for j in range(k, k + 10))) for k in range(3)], "item_id long, text string")
    return docs, bench


def test_contamination_is_one_python_step(spark):
    plan = decontaminate.contamination(*_tables(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_contamination_in_passes_is_the_same(spark, monkeypatch):
    docs, bench = _tables(spark)
    one = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    assert sum(r[-1] for r in one) == 20
    monkeypatch.setattr(decontaminate, "_PASS_BYTES", 100)
    passes = decontaminate.contamination(docs, bench)
    assert sorted(map(tuple, passes.collect())) == one
    # nothing of Python stands above the merge of the passes
    assert passes._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


def test_large_values_have_pages_of_their_own(spark):
    rows = spark.range(0, 8, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).select(F.expr("cast(repeat(h, 40000) as binary)").alias("value"))  # 2.5 MB each
    path = settle(rows, "wide").inputFiles()[0]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    pages = sum(reader.readOffsetIndex(b.getColumns().get(0)).getPageCount() for b in reader.getFooter().getBlocks())
    reader.close()
    assert pages >= 8
