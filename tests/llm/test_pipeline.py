import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from changelens.llm import decontaminate  # noqa: E402

D = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= len(seen)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    kept = {r.doc_id: r for r in docs.collect()}
    assert final.keys() == kept.keys()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    grams = decontaminate.Grams(items, 10)
    texts = set()
    for i, r in kept.items():
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        assert list(final[i].ids) == ids
        assert final[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert not grams.hits(decontaminate.words(r.text))[0]
        assert r.n_chars == len(r.text)
        if len(r.text) > 200:
            assert r.text not in texts
            texts.add(r.text)


LONG = "one two three four five six seven eight nine ten eleven twelve thirteen " * 2_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a few words"), (4, "a few words"), (None, "no id é"), (5, LONG), (6, "\x00▁<s>日本")]


@pytest.mark.parametrize("rows, kept", [(ODD, [None, 1, 4, 5, 6]), ([], [])])
def test_odd_rows(spark, tmp_path, monkeypatch, rows, kept):
    """Nulls in any column, empty and long texts, repeats, an empty table, further columns whose names clash."""
    like = spark.read.parquet(f"{D}/documents.parquet").schema
    docs = spark.createDataFrame([[dict(zip(("doc_id", "text"), r)).get(c) for c in like.names] for r in rows], like)
    docs = docs.withColumns({c: F.lit(c) for c in ("uid", "_uid", "_spans", "fp", "tkey", "_sh_id", "_tox_id", "item_id", "toxic")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = []

    def seen(spark, df, name):
        steps.append(corpus_written(spark, df, name))
        return steps[-1]

    corpus_written = corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", seen)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(steps) == len(corpus_pipeline.STAGES) - 1
    for step in steps:
        assert step.columns == docs.columns
        assert all(r._uid == "_uid" and r._spans == "_spans" and r.toxic == "toxic" for r in step.collect())
    last = steps[-1].collect()
    for out in (last, final):
        assert sorted((r.doc_id for r in out), key=lambda i: (i is not None, i)) == kept
    if rows:
        left = {r.doc_id: r.text for r in last}
        assert left[4] == "a few words" and left[None] == "no id é" and 0 < len(left[5]) < len(LONG)
