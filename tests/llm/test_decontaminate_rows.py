"""Decisions by row, the same for a benchmark in one block or in many."""

import pytest

from tracelake.llm import decontaminate


@pytest.mark.parametrize("chars", [16_000_000, 200])
def test_rows_that_share_an_id(spark, documents, chars):
    item = lambda k: " ".join(f"x{k}y{i}" for i in range(12))
    bench = spark.createDataFrame([(k, item(k)) for k in range(20)], "item_id long, text string")
    docs = documents([(1, item(3)), (1, "a clean text of the same id"), (None, item(4)), (None, "clean without an id"), (2, item(5)), (2, item(5)), (3, None), (3, None)])
    out = sorted((r.doc_id or 0, r.contaminated, r.item_id or 0, r.n_tiles) for r in decontaminate.scan(docs, bench, chars=chars).collect())
    assert out == [(0, False, 0, 0), (0, True, 4, 1), (1, False, 0, 0), (1, True, 3, 1), (2, True, 5, 1), (2, True, 5, 1), (3, False, 0, 0), (3, False, 0, 0)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in decontaminate.drop_contaminated(docs, bench, chars=chars).collect())
    assert kept == [(0, "clean without an id"), (1, "a clean text of the same id"), (3, ""), (3, "")]


def test_clashing_names(spark, documents):
    bench = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(12)))], "item_id long, text string")
    docs = documents([(1, " ".join(f"x{i}" for i in range(12))), (2, "clean")]).selectExpr("*", "'x' as _hit_id", "'y' as _hit_digest", "'z' as _id", "'k' as _key")
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
