"""Each stage of the corpus pipeline against what its operator says, on real and odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest

from agrolith.llm import pii, probminhash


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix_sources", "pack"]
    for name in ("language", "near_duplicates", "personal_data", "mix_sources"):
        assert stages[name].columns == list(pipeline.COLUMNS)


def test_language_keeps_clean_documents(stages):
    before, after = stages["documents"].count(), stages["language"].count()
    assert 0.97 * before <= after <= before


def test_one_document_of_each_class_stays(stages):
    rows = {r["doc_id"]: r["class_id"] for r in probminhash.classes(stages["language"]).collect()}
    assert sorted(r["doc_id"] for r in stages["near_duplicates"].collect()) == sorted(set(rows.values()))


def test_one_row_of_each_class_stays_whatever_its_id(spark, docs_of, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(5, a), (None, a + " near"), (None, b), (None, b), (7, c), (7, c), (7, c), (7, a + " far"), (8, None), (8, ""), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs_of(rows), sf).collect()]
    assert len(got) == 4 and {(5, a), (None, b), (7, c)} < set(got) and {x for x in got if not x[1]} <= {(8, None), (8, "")}


def test_no_personal_data_is_left(stages):
    assert pii.find(stages["personal_data"]).where("size(spans) > 0").count() == 0
    assert stages["personal_data"].where("n_chars <> length(text)").count() == 0
    assert stages["personal_data"].count() == stages["near_duplicates"].count()


def test_mix_repeats_documents(stages):
    n = Counter(r["doc_id"] for r in stages["mix_sources"].collect())
    assert set(n.values()) <= {1, 2} and set(n) <= {r["doc_id"] for r in stages["personal_data"].collect()}


def test_pack_holds_the_mix(stages):
    first = Counter(r["doc_id"] for r in stages["pack"].where("start = 0").collect())
    assert first == Counter(r["doc_id"] for r in stages["mix_sources"].collect())


def test_run(spark, sf, stages):
    assert pipeline.run(spark, sf).count() == stages["pack"].count()


def test_odd_rows_pass(spark, odd, no_docs, sf):
    for rows, least in ((odd, 1), (no_docs, 0)):
        docs, columns = rows, list(pipeline.COLUMNS)
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "pack" or docs.columns == columns
            assert docs.count() >= least
