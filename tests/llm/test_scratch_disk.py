"""What operators leave on the disks of executors."""

import random
import time

from pyspark.sql import functions as F

from lexikv.llm import lm
from tests.llm.conftest import make_docs


def _shuffled(spark):
    """Bytes of each shuffle file of this one-machine session."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_scoring_keeps_no_shuffled_texts_or_messages(spark):
    rng = random.Random(1)
    docs = make_docs(spark, [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(200)), "s") for i in range(200)])  # 440 kB that don't compress
    before, key = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    scored = lm.score_texts(docs, F.lit(False), lm.Settings(block_bytes=50_000))
    for _ in range(50):  # files go in the background
        left = sum(n for name, n in _shuffled(spark).items() if name not in before)
        if left < 50_000:
            break
        time.sleep(0.1)
    assert left < 50_000
    assert spark.conf.get(key) == kept
    assert scored.count() == 200
    assert scored.count() == 200  # a second run deals the texts again
