"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds, and each
normalised byte records the source byte that it comes from. Pieces are lengths of normalised bytes, so
their running sum, looked up in that record, gives the bytes of the original text that each stands for.
The spans of a text's pieces follow one another without a gap or an overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxmill.llm import words as W
from voxmill.llm.common import small_batches, text_key

#: Stands for a space in pieces.
MARK = "▁".encode()
#: Types of pieces in a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
#: Bytes of text that the library encodes at a time, unless no cut is possible.
STRETCH = 1 << 20


class CharMap:
    """A compiled character map: byte transitions in a double array, whose leaves name replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size:]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that ``data`` holds at ``at``, and the key's length."""
        place, found = self._jump(self.units[0]), None
        for i in range(at, len(data)):
            place ^= data[i]
            unit = self.units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._jump(unit)
            if unit & 0x100:
                found = self.units[place] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.strings[found[0]:self.strings.index(b"\0", found[0])], found[1]


class Codec:
    """One model: its normalisation, its pieces, and the library's encoder."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.char_map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.space = MARK if spec.escape_whitespaces else b" "
        names = [p.piece.encode() for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.length = np.array([1 if k == BYTE else len(n) for n, k in zip(names, kinds)], dtype=np.int64)
        self.byte = np.array([k == BYTE for k in kinds])
        self.byte_value = np.array([int(n[3:5], 16) if k == BYTE else 0 for n, k in zip(names, kinds)], dtype=np.uint8)
        self.unknown = np.array([k == UNKNOWN for k in kinds])
        self.user = sorted((n for n, k in zip(names, kinds) if k == USER_DEFINED), key=len, reverse=True)
        self.plain = self.char_map is None and not self.user and not self.squeeze and self.prefix and not self.suffix
        # where no piece goes on over a space after something else, what is before and after it never merges
        joined = any(_inner_space(n) for n, k in zip(names, kinds) if k != BYTE)
        self.cuts = self.plain and self.space == MARK and not joined

    def _prefix_of(self, data: bytes, at: int) -> tuple[bytes, int]:
        for symbol in self.user:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        found = self.char_map.longest(data, at) if self.char_map else None
        if found is not None:
            return found
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at:at + n], n

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, the source byte of each and the end): whole UTF-8 characters, longest prefixes first."""
        out, source, at = bytearray(), [], 0
        if not data:
            return b"", np.zeros(1, dtype=np.int64)

        def put(piece: bytes) -> None:
            shown = piece.replace(b" ", self.space)
            out.extend(shown)
            source.extend([at] * len(shown))

        after_space = self.squeeze
        if self.squeeze:
            while at < len(data) and self._prefix_of(data, at)[0] == b" ":
                at += self._prefix_of(data, at)[1]
            if at == len(data):
                return b"", np.array([0], dtype=np.int64)
        if self.prefix and not self.suffix:
            put(b" ")
        while at < len(data):
            piece, n = self._prefix_of(data, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece)
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                at = source[len(out) - len(self.space)]
                del out[-len(self.space):], source[-len(self.space):]
        if self.prefix and self.suffix:
            put(b" ")
        return bytes(out), np.array([*source, at], dtype=np.int64)

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in stretches that encode to the ids of the whole, if the model allows any cut.

        A cut is at a space after something that is no space. The space is left out, since the prefix that
        the library puts before a text stands for it.
        """
        at = 0
        while self.cuts and len(text) - at > STRETCH:
            cut = text.find(" ", at + STRETCH)
            while cut > 0 and text[cut - 1] in " ▁":
                cut = text.find(" ", cut + 1)
            # what follows must not be empty: the library gives an empty text no prefix
            if cut < 0 or cut + 1 >= len(text):
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, first): the pieces of all texts one after the other, the byte of its text where each
        ends, and the place of each text's first. A piece begins where the one before it ends."""
        parts = [list(self._stretches(t)) for t in texts]
        got = self.library.encode([s for p in parts for s in p], return_type="numpy", num_threads=1)
        counts, at = [], 0
        for p in parts:
            counts.append(sum(len(x) for x in got[at:at + len(p)]))
            at += len(p)
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in got]) if first[-1] else np.zeros(0, dtype=np.int64)
        lengths = self.length[ids]
        # an unknown piece is as long as what it stands for, which only the library's own record of the text tells
        for i in np.unique(W.per_text(ids, first)[self.unknown[ids]]):
            own = slice(first[i], first[i + 1])
            shown = self.library.encode(texts[i], return_type="proto").pieces
            lengths[own] = [len(p.piece.encode()) if self.unknown[p.id] else n for p, n in zip(shown, lengths[own])]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = total[1:] - np.repeat(total[first[:-1]], counts)
        if self.plain:
            return ids, self._plain_ends(texts, ids, ends, first), first
        out = np.zeros(len(ids), dtype=np.int64)
        for i, text in enumerate(texts):
            own = slice(first[i], first[i + 1])
            out[own] = self._projected(ids[own], ends[own], self.normalise(text.encode())[1])
        return ids, out, first

    def _projected(self, ids: np.ndarray, ends: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Ends in the source of pieces that end at these normalised bytes. Of the byte pieces of one character
        the last has its bytes, those before it none: they end where it begins."""
        return source[ends - self._within(ids)] if len(ids) else ends

    def _within(self, ids: np.ndarray) -> np.ndarray:
        """How many bytes of its character are before the end of each byte piece, if it is not the last."""
        out = np.zeros(len(ids), dtype=np.int64)
        at = np.flatnonzero(self.byte[ids])
        if len(at):
            value = self.byte_value[ids[at]]
            starts = (value & 0xC0) != 0x80
            size = np.where(value < 0x80, 1, np.where(value < 0xE0, 2, np.where(value < 0xF0, 3, 4)))
            lead = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            nth = np.arange(len(at)) - lead + 1
            out[at] = np.where(nth < size[lead], nth, 0)
        return out

    def _plain_ends(self, texts: list[str], ids: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """As :meth:`_projected` for all texts at once, where only spaces change their length."""
        data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
        sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        grown = np.where(data == 0x20, len(self.space), 1)
        source = np.concatenate([np.repeat(np.arange(len(data)), grown), [len(data)]])
        norm_begin = np.concatenate([[0], np.cumsum(grown)])[begin[:-1]]
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        # the prefix comes before the first byte of its text
        place = np.maximum(ends - self._within(ids) - len(self.space), 0) + norm_begin[text]
        return source[place] - begin[:-1][text]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        return self.library.decode([ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]) if len(first) > 1 else []


def _inner_space(name: bytes) -> bool:
    """Whether a piece has a space after something that is no space."""
    while name.startswith(MARK):
        name = name[len(MARK):]
    return MARK in name or b" " in name


@lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, tkey, ids, ends and decoded, one row per input row.

    ``ids`` are the pieces of the whole text as the sentencepiece library gives them, without begin and end
    ids; piece i stands for the bytes ends[i - 1] (0 for the first) to ends[i] of the text in UTF-8, with
    byte pieces of one character all but the last standing for none, and the prefix that a model adds too.
    ``decoded`` is what the library makes of the ids. A null text is empty and has no pieces. Very long texts
    are encoded in stretches where the model's pieces allow cuts, otherwise whole. Repeated rows and ids
    have rows of their own, empty tables none; other columns are ignored. The model file is read on the
    driver, so it need not lie on the executors.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model.value)
        for b in batches:
            for at, texts in W.runs(b.column("text")):
                ids, ends, first = own.encode([t or "" for t in texts.to_pylist()])
                offsets = pa.array(first.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(texts)), b.column("tkey").slice(at, len(texts)),
                     pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32))),
                     pa.array(own.decode(ids, first), pa.string())], names=["doc_id", "tkey", "ids", "ends", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", text_key().alias("tkey"), "text").mapInArrow(
        coded, f"doc_id {kind}, tkey bigint, ids array<int>, ends array<int>, decoded string")
