"""The corpus pipeline over a small corpus with repeated ids, nulls and an extra column."""

import random

import pytest

import corpus_pipeline

WORDS = "the and of thing water house seven mother river stone light paper".split()


def prose(seed, n):
    r = random.Random(seed)
    return ". ".join(" ".join(r.choice(WORDS) + r.choice(["", "s", "er"]) + str(r.randrange(60)) for _ in range(9)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = " ".join(f"q{i}w" for i in range(14))
    good = [(i, prose(i, 8)) for i in range(60)]
    edited = " ".join(w if k != 30 else "edited" for k, w in enumerate(prose(5, 8).split()))
    rows = [*good, (200, prose(3, 8)), (201, prose(4, 8).upper()), (202, edited), (5, prose(77, 8)), (203, prose(203, 4) + " " + item + " " + prose(204, 4)), (None, prose(6, 8)), (7, prose(7, 8))]
    rows += [(300 + i, " ".join(w + "!!%%%##" for w in prose(i, 6).split())) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, docs.columns


def test_stages_keep_clean_documents(spark, corpus):
    folder, rows, columns = corpus
    docs, left = corpus_pipeline.read(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, folder))
        assert docs.columns == columns
        left[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect())
    texts = dict(rows)
    good = left["quality classifier"]
    assert {i for i, _ in good} >= {*range(60), 200, 201, 202, 203, -1} and not {i for i, _ in good} & set(range(300, 330))
    unique = left["exact dedup"]
    kept = {i for i, _ in unique}
    assert 200 in kept and 3 not in kept and 201 in kept and 4 not in kept  # the largest id of equal texts stays
    assert sum(t == prose(7, 8) for _, t in unique) == 1 and -1 not in kept  # identical rows once; no id never wins
    assert {t for i, t in unique if i == 5} == {prose(5, 8), prose(77, 8)}  # an id may stand for two texts
    joined = left["n-gram Jaccard join"]
    assert set(unique) - set(joined) == {(202, texts[202])}
    assert set(joined) - set(left["benchmark decontamination"]) == {(203, texts[203])}


def test_whole_run(spark, corpus):
    folder, _, _ = corpus
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} >= {*range(8, 60), 200, 201} and not {r.doc_id for r in out} & {3, 4, 202, 203, *range(300, 330)}


def test_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for t in ("documents", "labels", "benchmark"):
        corpus_pipeline.read(spark, folder, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
