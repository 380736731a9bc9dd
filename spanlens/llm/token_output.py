"""Token ids in length-delimited binary records with a separate offset index.

A shard file is a 16-byte header (``TOKREC01``, bytes for each id, zero) and one
frame for each document, all numbers little-endian::

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

The payload is the document's id (i64), a byte that is 1 if that id is null, and
the token ids at the header's width.  Masking turns a CRC by 15 bits and adds a
constant, so that data which itself holds CRCs is no weak spot.  Beside each
shard, ``.idx`` holds the offset of every frame (u64 each), for reads in any order.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.storage import open_store, publish
from spanlens.llm.textbytes import map_texts

MAGIC = b"TOKREC01"
SHARD_BYTES = 32 << 20
MOST_SHARDS = 100_000
#: Most bytes of each of an encoder's three tables, and what an entry takes besides its word and ids.
TABLE_BYTES, ENTRY_BYTES = 56 << 20, 200
READ_PIECE = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """Whole-text encoding by a tokenizer file, with results kept for repeated units.

    For a byte-level BPE with its usual splitting pattern, a space that follows
    a non-space always starts a new piece, so a text falls into units there and
    the units' ids are the text's ids.  Units met before come from a table;
    one of ``TABLE_BYTES`` becomes the older of two and a new one is begun, so
    memory is bounded and words that come again are kept.
    Other kinds of tokenizers encode each whole text.  Strings of special
    tokens within a text are ordinary text.
    """

    #: The splitting pattern and the bytes that stand for themselves in byte-level BPE.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*\Z")
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    CUT = re.compile(r"(?<=\S)(?= )")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(size - 1, end_id) < 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.end = np.array([end_id], self.type).tobytes()
        state = json.loads(self.tokenizer.to_str())
        pre = state.get("pre_tokenizer") or {}
        self.by_unit = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not state.get("normalizer") and state["model"]["type"] == "BPE" and not state["model"].get("dropout")
            and all(t["special"] for t in state.get("added_tokens", []))
        )
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(256 + k) for k, b in enumerate(other)}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.units_bytes = self.pieces_bytes = 0

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def _bpe(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # each byte stands for itself, but for the space
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.units.get(piece[1:]) if piece[0] == " " else self.pieces.get(piece)
        if found is None:
            found = self._bpe(piece)
            if piece[0] != " ":
                self.pieces_bytes += len(piece) + len(found) + ENTRY_BYTES
                if self.pieces_bytes > TABLE_BYTES:
                    self.pieces, self.pieces_bytes = {}, 0
                self.pieces[piece] = found
        return found

    def _unit(self, word: str) -> bytes | None:
        """Ids of a space and a word of plain characters, piece by piece; None for other words."""
        if word.isascii() and word.isalpha():
            return self._bpe(" " + word)  # such a unit is one piece
        if not self.PLAIN.match(word):
            return None
        if word.isalpha():
            return self._bpe(" " + word)
        stem, mark = word[:-1], word[-1]
        if stem.isalpha() and mark in self.MARKS:
            found = self.units.get(stem)
            return (self._bpe(" " + stem) if found is None else found) + self._piece(mark)
        return b"".join(map(self._piece, self.PATTERN.findall(" " + word)))

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of units that are a space and a word, by word."""
        odd, learnt, older = [], {}, self.older.get
        for word in words:
            found = older(word)
            if found is None:
                found = self._unit(word)
            if found is None:
                odd.append(word)
            else:
                learnt[word] = found
        for word, found in zip(odd, self._whole([" " + w for w in odd])):
            learnt[word] = found
        for word, found in learnt.items():
            self.units_bytes += len(word) + len(found) + ENTRY_BYTES
            if self.units_bytes > TABLE_BYTES:
                self.units, self.older, self.units_bytes = {}, self.units, 0
            self.units[word] = found
        return learnt

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(found.ids) for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> bytes | None:
        """Ids of a run of units; None if a word that is not known ends in white space or is empty."""
        known = self.units.get
        found = list(map(known, words))
        if None in found:
            new = {w for w, f in zip(words, found) if f is None}
            if any(not w or w[-1].isspace() for w in new):
                return None
            learnt = self._learn(new)
            found = [learnt[w] if f is None else f for w, f in zip(words, found)]
        return b"".join(found)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed ids of each text, with the end id."""
        for text in texts:
            if not self.by_unit:
                yield self._whole([text])[0] + self.end
                continue
            first, *words = text.split(" ")
            rest = None if words and first[-1:].isspace() else self._words(words)
            if rest is None:  # a space after white space: cut only where a space follows something else
                first, *units = self.CUT.split(text)
                rest = b"".join(self._whole(units))
            yield b"".join((self._first(first), rest, self.end))

    def _first(self, unit: str) -> bytes:
        """Ids of a text's first unit, which has no space before it."""
        if not self.PLAIN.match(unit):
            return self._whole([unit])[0]
        return b"".join(map(self._piece, self.PATTERN.findall(unit)))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each Python worker; its tables serve all tasks of the worker."""
    return Encoder(path, end_id)


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}"


def write_shards(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> list[dict]:
    """Write ``docs`` in ascending id order; the manifest, a dict for each shard.

    Null texts are empty; a null id sorts first; rows with the same id are
    ordered by text.  Every row is written, repeated rows too.  The manifest
    (also ``manifest.json``) has the shard's number, rows and ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, math.ceil(size / max(SHARD_BYTES, size / MOST_SHARDS)))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path, end_id)
        width = coder.type.itemsize
        offsets: list[int] = []
        tokens = 0

        def write(out) -> None:
            nonlocal tokens
            at = out.write(MAGIC + struct.pack("<II", width, 0))
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(texts)):
                    offsets.append(at)
                    tokens += len(ids) // width
                    at += out.write(frame(struct.pack("<qB", doc_id or 0, doc_id is None) + ids))

        path = _shard_path(folder, shard)
        publish(path + ".bin", write)
        publish(path + ".idx", lambda out: out.write(np.array(offsets, "<u8").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([len(offsets)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "rows", "ids"]
        )

    made = sorted(map_texts(ordered, run, "shard long, rows long, ids long").collect())
    manifest = [r.asDict() for r in made]
    publish(f"{folder}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def _unframe(data: bytes, at: int) -> tuple[bytes, int]:
    length_bytes = data[at : at + 8]
    length, crc = struct.unpack_from("<QI", data, at)
    if masked(length_bytes) != crc:
        raise ValueError("damaged length")
    payload = data[at + 12 : at + 12 + length]
    end = at + 12 + length
    if len(payload) != length or masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("damaged record")
    return payload, end + 4


def read_shard(path: str, order: list[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of a shard, in file order or by record numbers through the index."""
    store, inner = open_store(path)
    with store.open_input_stream(inner + ".idx") as source:
        offsets = np.frombuffer(source.read(), "<u8").tolist()
    with store.open_input_file(inner + ".bin") as source:
        size = source.size()
        head = source.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        kind = np.dtype(f"<u{struct.unpack_from('<I', head, 8)[0]}")
        ends = [*offsets[1:], size]
        spans = _pieces(offsets, ends) if order is None else [[k] for k in order]
        for records in spans:
            first = offsets[records[0]]
            data = source.read_at(ends[records[-1]] - first, first)
            for k in records:
                payload, _ = _unframe(data, offsets[k] - first)
                doc_id, missing = struct.unpack_from("<qB", payload)
                yield None if missing else doc_id, np.frombuffer(payload, kind, offset=9)


def _pieces(offsets: list[int], ends: list[int]) -> Iterator[range]:
    at = 0
    while at < len(offsets):
        to = at + 1
        while to < len(offsets) and ends[to] - offsets[at] <= READ_PIECE:
            to += 1
        yield range(at, to)
        at = to


def read_back(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files, a row for each record."""
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    numbers = [m["shard"] for m in manifest]
    starts = np.concatenate([[0], np.cumsum([m["ids"] for m in manifest])]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, begin, count, crc = [], [], [], []
                at = starts[k]
                for doc_id, tokens in read_shard(_shard_path(folder, numbers[k])):
                    ids.append(doc_id)
                    begin.append(at)
                    count.append(len(tokens))
                    crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (ids, begin, count, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = len(numbers)
    return spark.range(0, n, 1, n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files in ``folder`` and return what the files hold.

    ``start`` is the number of ids of all records before.  See `write_shards` for nulls,
    ties and repeated rows; an empty table makes files without records.
    """
    manifest = write_shards(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_back(docs.sparkSession, folder, manifest)
