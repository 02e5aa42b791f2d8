import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexikv.llm import queries, toxicity
from tests.llm import brute
from tests.llm.conftest import SF, make_docs


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, queries.table(spark, SF, "labels"), F.lit(False))
    kept = [r for r, p in zip(rows, toxicity.scores(pa.array([t for _, t in rows]), model), strict=True) if p < 0.3]
    groups = brute.near_duplicates(kept, 80)
    unique = [r for r in kept if groups[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    hit = {r[0] for r in brute.contamination(unique, items) if r[-1]}
    clean = [r for r in unique if r[0] not in hit]
    assert len(rows) > len(kept) > len(unique) > len(clean) > 50
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in clean:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update((i, a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes())) for a in range(0, len(ids), 1024))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == want
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    assert sum(used.values()) / (1024 * len(used)) > 0.98


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_filtering_stages_keep_columns_and_odd_rows(spark, odd_rows, stage):
    odd = make_docs(spark, [(i and i + 10_000, t, s) for i, t, s in odd_rows])
    docs = odd.unionByName(queries.table(spark, SF, "documents"), allowMissingColumns=True)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {None, 10_040, 10_041, 10_042} <= {r.doc_id for r in rows}
    assert {r.score for r in rows if r.doc_id is None or r.doc_id >= 10_000} == {9.0}  # a column of the input's own
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
