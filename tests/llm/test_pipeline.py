"""The pipeline against a brute-force version of its stages."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from bitloom.llm import common, op2_bpe
from tests.llm.test_pairs import hits_truth, jaccard_truth, lines_truth


@pytest.fixture
def small(spark, sf_dir, tmp_path):
    """A folder with some documents and the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "123 !", "en", "s", 5), (900003, "", None, None, None), (None, "a text without an id that stays", "en", "s", 3)], docs.schema)
    docs.unionAll(odd).unionAll(docs.where("doc_id % 50 = 0")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(op2_bpe.default_tokenizer())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    cut, _ = lines_truth(rows)
    rows = [(i, new) for (i, new), (_, old) in zip(cut, rows) if new == old or new.strip()]
    named = dict((i, t) for i, t in rows if i is not None)
    truth = jaccard_truth(list(named.items()))
    rows = [(i, t) for i, t in named.items() if truth[i][1] == i] + [(i, t) for i, t in rows if i is None]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {x[0] for x in hits_truth(rows, items) if x[2]}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows if i not in bad}
    got = corpus_pipeline.run(spark, small).collect()
    assert len(got) == len(want)
    import hashlib

    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in want.items()}


def test_empty(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30).selectExpr("*", "1 as score", "'x' as lang_pred", "2 as n")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_bpe_batches(spark, small, monkeypatch):
    """The last stage hands whole texts to Python in small batches, and leaves the session's setting as it was."""
    before = spark.conf.get(common.BATCH_ROWS)

    def sizes(df, *a, **b):
        def apply(batches):
            for x in batches:
                yield pa.RecordBatch.from_pydict({"n": [x.num_rows]})

        return df.select("doc_id").mapInArrow(apply, "n bigint")

    monkeypatch.setattr(op2_bpe, "encode_decode", sizes)
    docs = spark.range(3000).selectExpr("id as doc_id").coalesce(1)
    got = [r.n for r in corpus_pipeline.bpe(spark, docs, small).collect()]
    assert sum(got) == 3000 and max(got) <= corpus_pipeline.BPE_BATCH
    assert spark.conf.get(common.BATCH_ROWS) == before
