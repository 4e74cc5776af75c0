"""The pipeline on the smallest table: stages in order, each with effect on what the one before kept."""


import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_rows(spark):
    from fraudscope.llm.common import stored
    from tests.llm.test_operators import brute_components, brute_fingerprint, brute_suffix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).selectExpr("cast(-1 as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-" + name)
        kept.append(docs)
    assert [d.columns for d in kept[:-1]] == [columns] * 4
    sets = [{r["doc_id"]: r for r in d.collect()} for d in kept]
    assert -1 not in sets[0] and len(sets[0]) >= 195
    data = sorted((i, r["text"] or "") for i, r in sets[0].items())
    root = brute_components([brute_fingerprint(x) for _, x in data], 2)
    assert sorted(sets[1]) == sorted({r: i for (i, _), r in reversed(list(zip(data, root)))}.values())
    for i, n, gone, *_ in brute_suffix([(i, r["text"] or "") for i, r in sets[1].items()], 200):
        if not gone:
            assert sets[2][i]["text"] == sets[1][i]["text"]
        elif i in sets[2]:
            assert len(sets[2][i]["text"].encode()) <= n - gone and sets[2][i]["n_chars"] == len(sets[2][i]["text"])
    assert set(sets[3]) < set(sets[2]) and set(sets[4]) == set(sets[3])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(sets[4][i]["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids for i, r in sets[3].items())


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
