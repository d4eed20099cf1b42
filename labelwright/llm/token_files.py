"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped on reading.

A file set is a folder of parts, in the order of their numbers, and a manifest table (part, file, n_docs,
n_ids, base):

    <name>.bin   the ids of the part's documents, one after another, little endian, `width` bytes each
    <name>.idx   n_docs + 1 unsigned 64-bit offsets into .bin, counted in ids, the first one 0
    <name>.doc   n_docs signed 64-bit doc_ids (the smallest value stands for null)

The first id of a part within the set is its base: the prefix sum of n_ids over the parts before it. Tasks
write to names that no other attempt uses, and the manifest lists only files of attempts that ended, so a
lost executor or a repeated task leaves nothing wrong behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_texts, give_back, keep_cache, slices, whole_text, work_folder

NO_ID = -(2**63)
CACHE_ENTRIES = 1_500_000
CACHE_CHARS = 48
#: A line end between two characters that no definition calls white space is a pre-token of its own.
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
#: A space before a character that no definition calls white space always starts a pre-token.
_SPLIT = re.compile(r" (?=\S)")
_OTHER_SPACE = re.compile(r" (?!\S)")
#: Letters and the marks after them are separate pre-tokens (an apostrophe could begin a contraction).
_TAIL = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]+)")
#: What such a pre-token of marks may end in: few pieces get as far as the pattern.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
#: Pieces that are encoded by themselves: with blanks, or with what added tokens begin with.
_JOINS_BADLY = re.compile(r"[\s<]")
_worker: dict = keep_cache({})


class _Pieces:
    """The ids of pieces that follow `lead`, as bytes; at most `most` and those of the batch at hand."""

    def __init__(self, lead: str):
        self.lead, self.known, self.tails, self.most = lead, {}, {}, CACHE_ENTRIES

    def _encode(self, words: list[str], lead: str, into: dict, tokenizer, kind: str) -> None:
        import numpy as np

        if lead == " " and (starts := _worker["starts"]) is not None:
            words = self._encode_joined(words, starts, into, tokenizer, kind)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = [e.ids for e in tokenizer.encode_batch_fast([lead + x for x in part], add_special_tokens=False)]
            size = np.dtype(kind).itemsize
            ends = (np.cumsum([len(x) for x in ids]) * size).tolist()
            flat = np.fromiter(chain.from_iterable(ids), kind, ends[-1] // size).tobytes()
            at_ = 0
            for word, end in zip(part, ends, strict=True):
                into[word] = flat[at_:end]
                at_ = end

    @staticmethod
    def _encode_joined(words: list[str], starts, into: dict, tokenizer, kind: str) -> list[str]:
        """Encode words as one text, each after a space, and cut it where a token begins with that space; returns those left out, which hold a space or might hold an added token."""
        import numpy as np

        plain = [w for w in words if w and not _JOINS_BADLY.search(w)]
        left = [w for w in words if not w or _JOINS_BADLY.search(w)] if len(plain) < len(words) else []
        size = np.dtype(kind).itemsize
        for at in range(0, len(plain), 4_000):
            part = plain[at : at + 4_000]
            ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(starts[ids])
            if len(cuts) != len(part) or cuts[0]:
                left += part
                continue
            flat, ends, at_ = ids.astype(kind).tobytes(), [*(cuts[1:] * size).tolist(), len(ids) * size], 0
            for word, end in zip(part, ends, strict=True):
                into[word] = flat[at_:end]
                at_ = end
        return left

    def learn(self, needed: set, tokenizer, kind: str) -> set:
        """Make all needed pieces known; returns those too long to keep."""
        # not `needed - known.keys()`, which walks the whole cache for each batch
        missing = needed.difference(self.known)
        if not missing:
            return missing
        if len(self.known) + len(missing) > self.most:
            self.known = {k: v for k, v in self.known.items() if k in needed}
        if len(self.tails) > self.most // 16:
            self.tails = {}
        split = [(w, *m.groups()) for w in missing if w[-1:] in _MARKS and (m := _TAIL.fullmatch(w)) and "<|" not in w]
        whole = missing.difference(w for w, _, _ in split)
        whole.update(core for _, core, _ in split if core not in self.known)
        self._encode(list(whole), self.lead, self.known, tokenizer, kind)
        self._encode(list({t for _, _, t in split}.difference(self.tails)), "", self.tails, tokenizer, kind)
        for w, core, tail in split:
            self.known[w] = self.known[core] + self.tails[tail]
        return {w for w in whole | missing if len(w) > CACHE_CHARS}


def _space_tokens(tokenizer):
    """For each id whether its token begins with a space; None if an added token could be part of a piece without '<'."""
    import numpy as np

    if not all("<" in t.content for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    starts = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        starts[i] = token.startswith("\u0120")  # the byte-level form of a space
    return starts


def _open(path: str):
    import os

    if _worker.get("key") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _worker.clear()
        _worker.update(key=path, tokenizer=tokenizer, first=_Pieces(""), later=_Pieces(" "), size=tokenizer.get_vocab_size(with_added_tokens=True), starts=_space_tokens(tokenizer))
    return _worker


def id_width(path: str) -> int:
    """Bytes an id takes in a file: 2 if the vocabulary allows it, else 4."""
    return 2 if _open(path)["size"] <= 1 << 16 else 4


def encode_texts(texts: list[str], path: str, width: int, cache_entries: int = CACHE_ENTRIES) -> list[bytes]:
    """The ids of each text as little-endian integers. Pieces of a text that start at a space are encoded once and kept.

    Only for byte-level tokenizers without a prefix space: their pre-tokens never cross the split used here.
    """
    import gc

    w = _open(path)
    w["first"].most = w["later"].most = cache_entries
    kind = f"<u{width}"
    # no cycles are made here, and each collection would walk the caches and all the lists
    was = gc.isenabled()
    gc.disable()
    try:
        return _encode_texts(texts, w, kind)
    finally:
        if was:
            gc.enable()


def _encode_texts(texts: list[str], w: dict, kind: str) -> list[bytes]:
    # where each space starts a pre-token the plain split does the same, faster
    split = [[_SPLIT.split(line) for line in _LINE.split(t)] if _OTHER_SPACE.search(t) else [line.split(" ") for line in _LINE.split(t)] for t in texts]
    first, later = w["first"], w["later"]
    need_first, need_later = {"\n"}, set()
    for lines in split:
        for s in lines:
            need_first.add(s[0])
            need_later.update(s)  # the first piece too: it may come after a space elsewhere, and no copy of the list
    drop = [(p, p.learn(need, w["tokenizer"], kind)) for p, need in ((first, need_first), (later, need_later))]
    start, get, end = first.known, later.known.__getitem__, first.known["\n"]
    out = [end.join([start[s[0]] + b"".join(map(get, s[1:])) for s in lines]) for lines in split]
    for p, words in drop:
        for word in words:
            p.known.pop(word, None)
    return out


def write_token_files(docs: DataFrame, path: str, folder: str, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None, end_id: int | None = 0, parts: int | None = None, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Encode every text, in the order of `order` (doc_id if none), to a file set in `folder`; returns its manifest.

    A null text is empty (only its end id); null doc_ids come first; equal keys are dealt out and ordered by
    a hash of the text, then by the text, so a repeated doc_id can't fill one part. Repeated rows stay.
    cache_entries: pieces that a worker keeps encoded, of about 200 bytes each; the ids don't depend on it.
    """
    spark = docs.sparkSession
    width = id_width(path)
    keys = order or [doc_id]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text(text).alias("t")).withColumn("h", F.xxhash64("t"))
    by = [F.col(f"k{i}").asc_nulls_first() for i in range(len(keys))] + [F.col("doc_id").asc(), F.col("h").asc()]
    ordered = slim.repartitionByRange(n, *by).sortWithinPartitions(*by, F.col("t").asc()).select("doc_id", "t")

    def write(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        give_back()
        part = TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        ends, ids = [np.zeros(1, "<u8")], []
        tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        total = 0
        with store.open_output_stream(f"{base}/{name}.bin", buffer_size=1 << 20) as out:
            for whole in batches:
                for batch in slices(whole, 1, 1 << 20):
                    coded = [x + tail for x in encode_texts(batch.column(1).to_pylist(), path, width, cache_entries)]
                    out.write(b"".join(coded))
                    e = total + np.cumsum([len(x) // width for x in coded])
                    total = int(e[-1])
                    ends.append(e.astype("<u8"))
                    ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        for kind, content in (("idx", np.concatenate(ends)), ("doc", np.concatenate(ids) if ids else np.zeros(0, "<i8"))):
            with store.open_output_stream(f"{base}/{name}.{kind}") as out:
                out.write(content.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([sum(map(len, ids))], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    written = cut_texts(ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), folder, "written")
    # one row a file: the prefix sum over them is small however large the corpus is
    sizes = sorted((r.part, r.file, r.n_docs, r.n_ids) for r in written.collect())
    base, rows = 0, []
    for p, f, d, i in sizes:
        rows.append((p, f, d, i, base))
        base += i
    return spark.createDataFrame(rows, "part long, file string, n_docs long, n_ids long, base long")


def _map_file(store, path: str, kind: str):
    """A part's file memory-mapped; one that is in a remote store is first copied to the task's own folder."""
    import os
    import tempfile

    import numpy as np
    from pyarrow import fs

    if not store.get_file_info(path).size:
        return np.zeros(0, kind), None
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r"), None
    local = tempfile.NamedTemporaryFile(delete=False)
    with local, store.open_input_stream(path) as source:
        while chunk := source.read(1 << 22):
            local.write(chunk)
    return np.memmap(local.name, dtype=kind, mode="r"), lambda: os.unlink(local.name)


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, width: int, ids: bool = False) -> DataFrame:
    """doc_id, start (in the whole set), n_tokens, ids_crc32 of each document of a file set, from the mapped files; its ids too, if asked for.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    step = 4096

    def read(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_docs"]:
                    continue
                (flat, a), (idx, b), (doc, c) = (_map_file(store, f"{at}/{row['file']}.{k}", t) for k, t in (("bin", f"<u{width}"), ("idx", "<u8"), ("doc", "<i8")))
                for lo in range(0, len(doc), step):
                    own = np.asarray(doc[lo : lo + step])
                    ends = np.asarray(idx[lo : lo + len(own) + 1]).astype(np.int64)
                    wide = np.asarray(flat[ends[0] : ends[-1]]).astype("<u4")
                    cuts = ends - ends[0]
                    view = memoryview(wide).cast("B") if len(wide) else memoryview(b"")
                    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    cols = [pa.array(own, mask=own == NO_ID), pa.array(row["base"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(wide.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)
                for done in (a, b, c):
                    if done:
                        done()

    # one row a file: each file is its own task
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part").mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str, order: list[str] | None = None, end_id: int | None = 0, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Write docs as a file set in a new shared folder and read it back; see the two functions above."""
    spark = docs.sparkSession
    folder = work_folder(spark)
    manifest = write_token_files(docs, path, folder, order=order, end_id=end_id, cache_entries=cache_entries)
    return read_token_files(spark, manifest, folder, id_width(path))
