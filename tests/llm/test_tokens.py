import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from labelwright.llm.token_counts import check_model, count_texts, count_tokens  # noqa: E402
from labelwright.llm.token_files import encode_texts, token_files, write_token_files  # noqa: E402

from .helpers import documents, same, texts  # noqa: E402

PIECES = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "1", "23", "'s", "<|endoftext|>", "<s>", "\x1c", "　", "\xa0", "!", "漢", "😀", "\r\n", "Word.", "été;", " w.", "A\nB", "x<|", ".\n", "don't", "\x85", "Ａ"]


def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def random_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library_on_odd_texts():
    t = random_texts(3000, 1)
    assert count_texts(t, P.path("piece_bpe_32k.model")) == [len(x) for x in model().encode(t)]


def test_ids_equal_the_library_on_odd_texts():
    t = random_texts(3000, 2)
    want = [np.array(e.ids, "<u2").tobytes() for e in tokenizer().encode_batch(t, add_special_tokens=False)]
    assert encode_texts(t, P.path("byte_bpe_50k.json"), 2) == want


def test_model_with_joined_words_is_refused():
    class Fake:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    with pytest.raises(ValueError):
        check_model(Fake())


def test_counts_of_awkward_documents(spark):
    docs = documents(spark)
    m = model()
    want = [(i, len(t.encode()), len(m.encode(t)) if t else 0) for i, t in texts(docs)]
    assert same(count_tokens(docs, P.path("piece_bpe_32k.model")).collect(), want)
    assert count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_files_hold_every_document_in_order(spark):
    docs = documents(spark)
    got = token_files(docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    t = tokenizer()
    coded = sorted((i is not None, i or 0, len(e := [*t.encode(x, add_special_tokens=False).ids, 0]), zlib.crc32(np.array(e, "<u4").tobytes())) for i, x in texts(docs))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == coded
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_files(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_manifest_bases_are_prefix_sums(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    rows = write_token_files(docs, P.path("byte_bpe_50k.json"), f"file://{tmp_path}/set", parts=4).orderBy("part").collect()
    assert len(rows) > 1 and sum(r.n_docs for r in rows) == 50
    at = 0
    for r in rows:
        assert r.base == at
        at += r.n_ids
        assert np.memmap(f"{tmp_path}/set/{r.file}.bin", "<u2", "r").size == r.n_ids
        assert np.fromfile(f"{tmp_path}/set/{r.file}.idx", "<u8")[-1] == r.n_ids


def test_ids_do_not_depend_on_the_cache_size():
    import public_tokenizers

    from labelwright.llm.token_files import encode_texts

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(f"w{i * j}x, don't" for i in range(40)) + "\n\nend " for j in range(30)]
    whole = encode_texts(texts, path, 2)
    assert [encode_texts([t], path, 2, cache_entries=8)[0] for t in texts] == whole
    assert encode_texts(texts, path, 2) == whole


def test_cut_texts_puts_the_setting_back(spark, tmp_path):
    from labelwright.llm.common import BATCH_BYTES, cut_texts

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    docs = spark.range(0, 9000, 1, 1).selectExpr("repeat('x', 2000) AS t")
    rows = cut_texts(docs.mapInArrow(sizes, "n long, size long"), f"file://{tmp_path}", "sizes").collect()
    assert sum(r.n for r in rows) == 9000 and max(r.size for r in rows) < BATCH_BYTES + 100_000
    assert spark.conf.get(key) == was
