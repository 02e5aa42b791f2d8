"""Stages of the pipeline over rows without an id and rows that repeat one."""

from collections import Counter

import corpus_pipeline
from lexikv.llm import queries
from tests.llm.conftest import SF, make_docs, sentences


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c, d = (sentences(100 + i, 60) for i in range(4))
    rows = [(9, a), (3, a), (None, a), (5, b), (5, b), (5, c), (None, d), (None, d), (6, c), (7, None), (7, None), (None, ""), (None, "")]
    docs = make_docs(spark, [(i, t, "s") for i, t in rows])
    for some in (docs, docs.repartition(5)):
        out = corpus_pipeline.drop_near_duplicates(spark, some, SF)
        assert out.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, a), (5, b), (5, c), (None, d), (7, None), (7, None), (None, ""), (None, "")])


def test_every_contaminated_row_goes(spark):
    passage = queries.table(spark, SF, "benchmark").filter("length(text) > 60").first().text
    leak, clean = f"before {passage} after", sentences(7, 60)
    rows = [(None, leak), (None, clean), (1, leak), (1, clean), (1, clean), (2, leak), (2, leak), (3, clean)]
    out = corpus_pipeline.drop_contaminated(spark, make_docs(spark, [(i, t, "s") for i, t in rows]), SF)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(None, clean), (1, clean), (1, clean), (3, clean)])
