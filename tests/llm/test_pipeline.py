import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sheafline.llm import common, secret_scan, sentencepieces


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_000, None, "en", "s", 0), (90_001, "", None, None, 0), (90_002, "12 34", "en", "s", 5), (90_003, "A word token=abcdef123 more", "en", None, 27)], docs.schema)
    seen = [docs.union(odd)]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(common.written(stage(spark, seen[-1], sf), "test"))
    return seen


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_language_drops_what_is_in_none(stages):
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert ids(stages[1]) == sorted(i for i, t in texts.items() if t and any(c.isalpha() for c in t))


def test_one_of_equal_texts_stays(stages):
    first = {}
    for r in stages[1].orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    left = ids(stages[2])
    assert set(left) <= set(first.values()) and len(left) > 0.8 * len(first)


def test_secrets_go_and_documents_stay(stages):
    assert ids(stages[3]) == ids(stages[2])
    again = secret_scan.scan(stages[3])
    assert again.where(F.size("spans") > 0).count() == 0
    assert stages[3].where("n_chars <> length(text)").count() == 0
    assert stages[3].where("doc_id = 90003").first().text == "A word [SECRET] more"


def test_mixture_repeats_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    assert all(before[r.doc_id] == r.text for r in stages[4].collect())
    assert stages[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_tokens_decode(stages):
    coder = sentencepieces.Coder(sentencepieces.load())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert len(got) == stages[4].count() and all(coder.decode(r.ids) == texts[r.doc_id] for r in got)


def test_run(spark, sf):
    df = corpus_pipeline.run(spark, sf)
    assert df.columns == ["doc_id", "source", "n_tokens", "ids"] and df.count() > 0


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), "test")
    assert docs.count() == 0


