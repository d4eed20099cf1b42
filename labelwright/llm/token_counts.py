"""Token counts of whole texts by a two-tier lookup of pre-token lengths, with no shuffle of pre-tokens.

A piece model never merges across the start of a run of spaces (no piece has a space mark after another
character, but for pieces of space marks alone; `check_model` proves that for the model at hand), so the
count of a text is the sum of the counts of its pre-tokens: a run of spaces and the characters after it.
Tier one is a broadcast compact table of frequent pre-tokens, bounded by `table_size` entries, taken from a
bounded sample of documents; it decides speed only. Tier two encodes the misses of a batch in one call and
keeps them in a worker's cache of at most `CACHE_ENTRIES` entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_cache, slices, whole_text

#: Entries of a worker's cache; it starts anew beyond that.
CACHE_ENTRIES = 400_000
#: Longer pre-tokens are encoded each time, so the cache's bytes are bounded too.
CACHE_CHARS = 48
_RUN = re.compile(" +[^ ]*")
_worker: dict = keep_cache({})


def check_model(model) -> None:
    """Raise if a piece holds a space mark after another character: counts would not add up."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lstrip("▁")
        if "▁" in piece:
            raise ValueError(f"piece {i} joins words; pre-token counts don't add up for this model")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space mark; their counts add up to the text's count. '' has none."""
    if not text:
        return []
    text = text.replace("▁", " ")
    words = text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)] if "" in words else words


def _count_lists(model, words: list[str]) -> list[int]:
    """Lengths of pre-tokens; the empty one is a lone space mark."""
    return [len(ids) if w else 1 for w, ids in zip(words, model.encode(words, num_threads=1), strict=True)]


def _open(path: str, packed: tuple[str, bytes] | None):
    """The worker's model and cache, seeded with the broadcast table; one per worker and table."""
    import sentencepiece

    key = (path, id(packed) if packed is None else hash(packed))
    if _worker.get("key") != key:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        frequent = dict(zip(packed[0].split(" "), packed[1], strict=True)) if packed and packed[0] else {}
        _worker.clear()
        _worker.update(key=key, model=model, frequent=frequent, cache=dict(frequent))
    return _worker


def count_texts(texts: list[str], path: str, packed: tuple[str, bytes] | None = None) -> list[int]:
    """Token counts of texts, in order."""
    w = _open(path, packed)
    cache, out = w["cache"], []
    split = [pre_tokens(t) for t in texts]
    missing = set()
    for words in split:
        missing.update(words)
    missing.difference_update(cache)
    long = {}
    if missing:
        words = list(missing)
        found = dict(zip(words, _count_lists(w["model"], words), strict=True))
        long = {k: v for k, v in found.items() if len(k) > CACHE_CHARS}
        for k in long:
            del found[k]
        if len(cache) + len(found) > CACHE_ENTRIES:
            # the batch still needs what it found in the old cache
            used = set().union(*split)
            w["cache"] = cache = {k: v for k, v in cache.items() if k in used} | w["frequent"]
        cache.update(found)
    if long:
        for words in split:
            out.append(sum(long[x] if len(x) > CACHE_CHARS else cache[x] for x in words))
    else:
        get = cache.__getitem__
        out = [sum(map(get, words)) for words in split]
    return out


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text", sample_docs: int = 400, table_size: int = 40_000) -> tuple[str, bytes]:
    """The compact table: the most frequent pre-tokens of at most `sample_docs` documents, space-joined, and a byte of length each."""

    def top(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                found.update(x for x in pre_tokens(t.as_py()) if 0 < len(x) <= CACHE_CHARS and " " not in x)
        words = [x for x, _ in found.most_common(table_size)]
        yield pa.RecordBatch.from_pydict({"words": [" ".join(words)]})

    import sentencepiece

    rows = docs.select(whole_text(text).alias("t")).limit(sample_docs).coalesce(1).mapInArrow(top, "words string").collect()
    words = [w for r in rows for w in r.words.split(" ") if w]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    kept = [(w, n) for w, n in zip(words, _count_lists(model, words), strict=True) if n < 256] if words else []
    return " ".join(w for w, _ in kept), bytes(n for _, n in kept)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 400, table_size: int = 40_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs, as the piece model at `path` gives them.

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id and repeated rows stay, one row each; other
    columns of docs are not read, so their names can't clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(frequent_pre_tokens(docs, path, text, sample_docs, table_size))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, 2, 4 << 20):
                counts = count_texts(batch.column(2).to_pylist(), path, packed.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"), whole_text(text).alias("t"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
