from collections import Counter

import corpus_pipeline
from strandloom.llm import decontaminate, toxicity
from tests.llm.test_set_join import components_by_brute_force
from tests.llm.test_text_ops import odd_documents, removed_by_brute_force
from tests.llm.test_toxicity import vector

DIR = "/root/testdata/sf0.001"


def test_stages_are_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    read = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, columns = read(out), out.columns
        out = stage(spark, out, DIR)
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
            index = toxicity.Index.load(model)
            want = {i for i, t in before if index.score(index.all_similar(*vector(index, t))) < 0.5}
            assert {i for i, _ in read(out)} == want and len(want) <= len(before)
        elif name == "ngram_jaccard_join":
            want = {c for _, n, c in components_by_brute_force(before, 5, 80) if n} | {i for i, t in before if not (t or "").split()}
            assert {i for i, _ in read(out)} == want and len(want) <= len(before)
        elif name == "substring_dedup":
            want, _ = removed_by_brute_force(before, 50)
            for i, t in read(out):
                n, gone, _ = next(v for k, v in want.items() if k[0] == i)
                assert len((t or "").split()) == n - gone
        elif name == "benchmark_decontamination":
            items = [" ".join(decontaminate.normal_words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            after = dict(read(out))
            for i, t in before:
                if any(f" {x} " in f" {' '.join(decontaminate.normal_words(t))} " for x in items):
                    assert i not in after
        else:
            assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in before)


def test_run(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and empty tables."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, matches int, predicted int, k int"
    rows = [(i, t, None, "s", len(t or ""), 1, 2, 3) for i, t, *_ in odd_documents()]
    for name, data, kind in (("documents", rows, schema), ("labels", [(0, 0, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int"), ("benchmark", [(1, None), (None, "")], "item_id bigint, text string")):
        for part, some in (("full", data), ("empty", [])):
            spark.createDataFrame(some, kind).write.parquet(f"{tmp_path}/{part}/{name}.parquet")
    out = docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, f"{tmp_path}/full")
        assert name == "packing" or out.columns == docs.columns, name
    assert 0 < out.count() <= len(rows) and out.where("doc_id is null").count() <= 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
