"""The pipeline's stages hand rows to Python workers in batches of bounded bytes."""

from __future__ import annotations

import uuid

import corpus_pipeline
from strandline.llm import bpe
from strandline.llm.lean import BATCH_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_encoding_takes_small_batches(spark, tmp_path, monkeypatch):
    real, folder = bpe._encode, str(tmp_path)

    def watched(*args):
        run = real(*args)

        def handed(batches):
            for batch in batches:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(batch.nbytes))
                yield batch

        return lambda batches: run(handed(batches))

    monkeypatch.setattr(bpe, "_encode", watched)
    rows = [(i, f"{i} words " * 3000 if i % 9 else None, "en", "web", 0) for i in range(120)]
    longest = max(len(t or "") for _, t, *_ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.conf.unset(SETTING)
    try:
        done = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encode(spark, docs, "").select("doc_id", "n_tokens").collect()}
    finally:
        spark.conf.unset(SETTING)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(done) == list(range(120))
    assert all((n == 0) == (i % 9 == 0) for i, n in done.items())
    assert sum(sizes) > 2 * BATCH_BYTES  # else one batch would do
    assert max(sizes) <= BATCH_BYTES + 2 * longest
