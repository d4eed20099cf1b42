import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from . import test_near_copies  # noqa: E402
from .test_decontamination import brute  # noqa: E402


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf)
        out.write.parquet(f"{tmp_path}/{i}-{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}-{name}"))
    rows = [k.collect() for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [{r.doc_id for r in x} for x in rows]
    assert ids[1] == ids[0]
    g = test_near_copies.groups([r.text for r in rows[1]])
    assert ids[2] == {min(r.doc_id for r, c in zip(rows[1], g, strict=True) if c == own) for own in set(g)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids[3] == {i for _, i, _, hit, _ in brute([(r.doc_id, r.text) for r in rows[2]], items, 10) if not hit}
    assert ids[4] == ids[3] == ids[5]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    laid = [r.doc_id for r in kept[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    text = {r.doc_id: r.text for r in rows[4]}
    at, want = 0, []
    for i in laid:
        e = [*t.encode(text[i], add_special_tokens=False).ids, 0]
        want.append((i, at, len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
        at += len(e)
    assert sorted(map(tuple, rows[5])) == sorted(want)


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
