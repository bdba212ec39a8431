"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

Documents are put in order of doc_id over many files. Each file set has ids (flat little-endian
unsigned integers), the doc_ids, and offsets: n + 1 numbers of 64 bits that count ids from the start
of the whole output. A file's base is the number of ids in all files before it, which a prefix sum
over the files' counts gives once all are written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.common import Scratch

#: Words whose ids a task remembers; the memory is emptied when full.
REMEMBERED = 1_000_000
#: Texts with longer words are not remembered.
WORD_BYTES = 256
#: Stands for a null doc_id in the files.
NO_DOC = -(1 << 63)
MANIFEST = "part int, path string, first_doc bigint, docs bigint, tokens bigint"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it; works from any task."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, blobs: list[np.ndarray]) -> None:
    """Write a file under a name of this attempt, then rename: readers never see half a file."""
    store, path = _store(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(own) as out:
        for b in blobs:
            out.write(memoryview(np.ascontiguousarray(b)).cast("B"))
    store.move(own, path)


def _get(uri: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system, else read."""
    store, path = _store(uri)
    if store.get_file_info(path).size == 0:
        return np.zeros(0, dtype=kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


class Encoder:
    """Ids of whole texts, word by word.

    The vocabulary's normalizer and splitter never join characters across the six ASCII white
    space characters, so a text's ids are those of its words one after the other, and a word
    that was seen before need not be encoded again.
    """

    def __init__(self, path: str, kind: str, end: int):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.kind, self.end = kind, np.array([end], dtype=kind).tobytes()
        self.seen: dict[bytes, bytes] = {b"": b""}

    def _coded(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in got]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: encoded as one text, cut after each id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._coded(words)
        flat, starts = ids.astype(self.kind), [0, *ends[:-1].tolist()]
        return [flat[s:e].tobytes() for s, e in zip(starts, ends.tolist())]

    def _ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; a word that ends in full stops or commas is its letters and then these."""
        split, cores, rest = {}, set(), set()
        for raw in words:
            bare = raw.rstrip(b".,")
            core = bare.decode()
            if core.isalpha():
                if core.isascii():
                    bare = bare.lower()
                split[raw] = bare, raw[len(bare):]
                cores.add(bare)
                rest.add(raw[len(bare):])
            else:
                rest.add(raw)
        known = {w: self.seen[w] for w in cores | rest if w in self.seen}
        new = [w for w in cores if w not in known]
        plain = [w for w in new if w.isascii()]
        # lower-case ASCII letters pass the normalizer and the splitter unchanged
        tokenize = self.tokenizer.model.tokenize
        known.update((w, np.array([t.id for t in tokenize(w.decode())], dtype=self.kind).tobytes()) for w in plain)
        new = [w for w in new if not w.isascii()]
        for i in range(0, len(new), 500):
            known.update(zip(new[i:i + 500], self._letters([w.decode() for w in new[i:i + 500]])))
        new = [w for w in rest if w not in known]
        known.update(zip(new, self._coded([w.decode() for w in new])))
        known.update((w, known[core] + known[tail]) for w, (core, tail) in split.items())
        return known

    def encode(self, text: str) -> bytes:
        """The ids of one text and the end id, as bytes."""
        if "<|" in text:
            # perhaps a special token, which may stand within a word
            return self._coded([text])[0] + self.end
        # bytes.split parts words at the six ASCII white space characters
        words = text.encode().split()
        got = list(map(self.seen.get, words))
        if None in got:
            new = {w for w, ids in zip(words, got) if ids is None}
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
                self.seen[b""] = b""
            fresh = self._ids(new)
            if len(fresh) <= REMEMBERED and max(map(len, fresh)) <= WORD_BYTES:
                # else this text's words serve it alone
                self.seen.update(fresh)
            got = [fresh[w] if ids is None else ids for w, ids in zip(words, got)]
        return b"".join(got) + self.end


_ENCODERS: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, kind: str, end: int) -> Encoder:
    """The encoder of this Python worker, which keeps what it remembers from task to task."""
    if (path, kind, end) not in _ENCODERS:
        _ENCODERS[path, kind, end] = Encoder(path, kind, end)
    return _ENCODERS[path, kind, end]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int = 1, kind: str = "<u2",
                 part_bytes: int = 64 << 20) -> DataFrame:
    """Encode every text and write the files; returns the manifest, one row per file set, with bases.

    A null text is empty and so has only the end id. Rows are ordered by doc_id, null first, and
    rows that repeat a doc_id by text, so any number of them is written. An empty table gives no
    files; other columns are ignored. ``kind`` must hold the vocabulary's ids. A task that is run
    again replaces its own files.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the order of equal doc_ids is by hash, so that one doc_id may spread over files
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = rows.repartitionByRange(max(-(-size // part_bytes), least), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}"
        store, local = _store(path)
        own = f"{local}.{uuid.uuid4().hex}"
        ids, coder, docs_, lengths = None, None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            if ids is None:
                coder = encoder(vocabulary, kind, end)
                store.create_dir(os.path.dirname(local), recursive=True)
                ids = store.open_output_stream(own)
            got = b.column("doc_id")
            docs_.append(np.array([NO_DOC if x is None else x for x in got.to_pylist()], dtype="<i8"))
            for t in b.column("text").to_pylist():
                coded = coder.encode(t)
                lengths.append(len(coded) // np.dtype(kind).itemsize)
                ids.write(coded)
        if ids is None:
            return
        ids.close()
        store.move(own, f"{local}.ids")
        _put(f"{path}.docs", docs_)
        _put(f"{path}.lengths", [np.array(lengths, dtype="<u8")])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "first_doc": [int(docs_[0][0])],
                                          "docs": [len(lengths)], "tokens": [int(sum(lengths))]})

    files = scratch.keep(placed.select("doc_id", "text").mapInArrow(write, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of up to part_bytes
    files = scratch.keep(files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lengths = _get(f"{row['path']}.lengths", "<u8")
                ends = np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]) + np.uint64(row["base"])
                _put(f"{row['path']}.offsets", [ends.astype("<u8")])
            yield b

    return scratch.keep(files.repartition("part").mapInArrow(offsets, MANIFEST + ", base bigint"))


def read_tokens(manifest: DataFrame, kind: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                ids, offsets = _get(f"{path}.ids", kind), _get(f"{path}.offsets", "<u8").astype(np.int64)
                docs = np.asarray(_get(f"{path}.docs", "<i8"))
                crcs = np.fromiter((zlib.crc32(ids[s - base:e - base].astype("<u4").tobytes())
                                    for s, e in zip(offsets[:-1], offsets[1:])), dtype=np.int64, count=len(docs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_DOC), pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("part", "path", "base").repartition("part").mapInArrow(read, schema)
