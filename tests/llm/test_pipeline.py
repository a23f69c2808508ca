"""The pipeline on planted cases, its stages by brute force, and what every stage returns."""

import pytest

import corpus_pipeline
from granary.llm.common import staged

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = docs.filter("doc_id = 601").first()
    extra = spark.createDataFrame(
        [(90_001, clean.text, "en", "s", 1), (90_002, clean.text + " and one more word", "en", "s", 1), (90_003, "1234 %% 99", "en", "s", 1), (90_004, None, "en", "s", 0), (90_005, "the idiot and the worthless scum of the moron trash " * 4, "en", "s", 1)],
        docs.schema,
    )
    docs = out = staged(docs.unionAll(extra), "docs")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, out, FOLDER), name)
        held.append(out)
    return held


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 4
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_planted_cases(stages):
    before, toxic, language, near, packed = map(ids, stages)
    assert 90_005 in before - toxic
    assert {90_003, 90_004} & toxic and not {90_003, 90_004} & language
    assert {90_001, 90_002} <= language and not {90_001, 90_002} & near
    assert packed == near


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0")
    clean = {r.doc_id for r in stages[0].join(labels, "doc_id", "left_semi").collect()}
    assert len(clean - ids(stages[1])) <= 0.03 * len(clean)
    assert len(ids(stages[1]) - ids(stages[2])) <= 0.01 * stages[0].count() + 2


def test_near_copies_by_brute_force(stages):
    from test_pairs import brute

    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    _, root = brute([t for _, t in rows])
    assert ids(stages[3]) == {rows[r][0] for r in set(root)}


@pytest.mark.parametrize("n", [0, None])
def test_stages_take_any_columns_and_no_rows(spark, n):
    held = [(1, None, None, "s", None), (None, "", "en", None, 0), (2, "the and of in a word or two", "en", "s", 1), (2, "the and of in a word or two", "en", "s", 1), (3, "1 2 3", "en", "s", 5), (4, "the word " * 50_000, "en", "s", 5)]
    rows = [(*r, 0.5, "x", 7, "y", 1.0, True) for r in held]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, class_id int, row string, sequence_id double, kept boolean"
    docs = staged(spark.createDataFrame(rows[:n], names), "any")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        assert (out.count() == 0) if n == 0 else {2, 4} <= ids(out)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert (packed.count() == 0) if n == 0 else ids(packed) == {None, 1, 2, 3, 4}
