"""Token-ID files: bit-plane shuffled blocks, each plane compressed with zstandard, found through a chunk index.

A file holds the ids of a run of documents in ascending order of their key. It is a sequence of frames,
each followed by the four bytes ``MARK``; integers are little-endian:

* chunk frames: a block of ``BLOCK`` ids (the last one shorter), turned into planes: plane b has bit (or
  byte) b of every id, and only planes up to the highest bit that the block uses are stored. Each plane is a
  zstandard frame of its own, so a reader may fetch any of them;
* the document table (zstandard): a flag per document whether its key is null, the keys (int64) and the
  numbers of ids (int64);
* the chunk index: per chunk its offset, number of ids, number of planes, the length of each plane and the
  CRC-32 of its ids;
* the footer of fixed size: offsets and lengths of table and index, ids and documents of the file, the
  file's place in the order of all files, kind of planes and block size.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densel.llm.tables import batches_of, ranked, written

BLOCK = 1 << 16
MARK = b"IDP1"
FOOTER = struct.Struct("<QQQQQQQQQ")
#: Text bytes that one file holds, about; a file is written and read by one task.
TEXT_BYTES_PER_FILE = 64 << 20
#: Distinct words whose ids a task remembers.
WORDS_HELD = 1 << 20
#: Rows handed to Python at once.
ROWS = 500


# ------------------------------------------------------------------ planes
def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, up to the highest that is not all zero."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        return [octets[:, b].tobytes() for b in range(-(-top // 8))]
    out = []
    for b in range(top):
        out.append(np.packbits((octets[:, b // 8] >> np.uint8(b % 8)) & np.uint8(1), bitorder="little").tobytes())
    return out


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    """The ``n`` ids of a block."""
    octets = np.zeros((n, 4), np.uint8)
    for b, plane in enumerate(planes):
        if kind == "byte":
            octets[:, b] = np.frombuffer(plane, np.uint8)
        else:
            octets[:, b // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(b % 8)
    return octets.view("<u4").reshape(-1)


# ------------------------------------------------------------------ one file
class FileWriter:
    """Frames of one file: ``add`` documents in order, then ``close``; both return the frames that became complete."""

    def __init__(self, place: int, kind: str = "bit", block: int = BLOCK, level: int = 3):
        self.place, self.kind, self.block = place, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.offset, self.held, self.n_held, self.n_ids = 0, [], 0, 0
        self.index: list[bytes] = []
        self.nulls, self.keys, self.counts = [], [], []

    def _frame(self, body: bytes) -> bytes:
        self.offset += len(body) + len(MARK)
        return body

    def _chunk(self, ids: np.ndarray) -> bytes:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append(struct.pack(f"<QIB{len(planes)}II", self.offset, len(ids), len(planes), *map(len, planes),
                                      zlib.crc32(ids.astype("<u4").tobytes())))
        return self._frame(b"".join(planes))

    def add(self, key: int | None, ids: np.ndarray) -> list[bytes]:
        self.nulls.append(key is None)
        self.keys.append(key or 0)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held < self.block:
            return []
        every = np.concatenate(self.held)
        whole = len(every) // self.block * self.block
        self.held, self.n_held = [every[whole:]], len(every) - whole
        return [self._chunk(every[i:i + self.block]) for i in range(0, whole, self.block)]

    def close(self) -> list[bytes]:
        out = [self._chunk(np.concatenate(self.held))] if self.n_held else []
        docs = self.zstd.compress(np.array(self.nulls, np.uint8).tobytes() + np.array(self.keys, "<i8").tobytes()
                                  + np.array(self.counts, "<i8").tobytes())
        docs_at = self.offset
        out.append(self._frame(docs))
        index = b"".join(self.index)
        index_at = self.offset
        out.append(self._frame(index))
        out.append(FOOTER.pack(docs_at, len(docs), index_at, len(index), self.n_ids, len(self.keys), self.place,
                               self.kind == "bit", self.block))
        return out


def read_chunks(content: memoryview, index: bytes, kind: str, first: int = 0) -> Iterator[np.ndarray]:
    """The ids of each chunk from number ``first`` on; ValueError if a chunk is damaged."""
    zstd = zstandard.ZstdDecompressor()
    at = 0
    while at < len(index):
        offset, n, n_planes = struct.unpack_from("<QIB", index, at)
        lengths = struct.unpack_from(f"<{n_planes}I", index, at + 13)
        (crc,) = struct.unpack_from("<I", index, at + 13 + 4 * n_planes)
        at += 17 + 4 * n_planes
        if first:
            first -= 1
            continue
        planes = []
        for length in lengths:
            planes.append(zstd.decompress(content[offset:offset + length]))
            offset += length
        ids = from_planes(planes, n, kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("chunk damaged")
        yield ids


def read_file(content: memoryview) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(facts, null flags, keys, numbers of ids, chunks) of a file; ValueError if it is cut short."""
    if len(content) < FOOTER.size + len(MARK) or bytes(content[-len(MARK):]) != MARK:
        raise ValueError("file cut short")
    docs_at, docs_n, index_at, index_n, n_ids, n_docs, place, bits, block = FOOTER.unpack_from(
        content, len(content) - FOOTER.size - len(MARK))
    docs = zstandard.ZstdDecompressor().decompress(content[docs_at:docs_at + docs_n])
    nulls = np.frombuffer(docs, np.uint8, n_docs).astype(bool)
    keys = np.frombuffer(docs, "<i8", n_docs, n_docs)
    counts = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
    index = bytes(content[index_at:index_at + index_n])
    return ({"n_ids": n_ids, "place": place, "block": block}, nulls, keys, counts,
            read_chunks(content, index, "bit" if bits else "byte"))


# ------------------------------------------------------------------ encoding
#: Words of these letters alone are one piece to the tokenizer's splitter, in lower case and composed form already.
_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
#: A sign of these after an ASCII letter or digit is a piece of its own where nothing follows it.
_SIGN = re.compile(rb".*[A-Za-z0-9][.,;:!?]", re.DOTALL)


def byte_characters() -> dict[int, int]:
    """The characters that stand for the bytes of a byte-level vocabulary: printable bytes stand for themselves, others for those from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


class Encoder(dict):
    """Token ids of whole texts, from the tokenizers library.

    It numbers the words between ASCII blanks as they are first met and remembers their ids: a tokenizer that
    lower-cases, drops white space and splits letters from signs has the ids of a text's words one after the
    other. A word of letters goes straight to the vocabulary's model, any other through the whole tokenizer.
    Special tokens may stand in a text as they are. ``whole=True`` encodes each text in one call instead, for
    tokenizers of another kind.
    """

    def __init__(self, path: str, end_id: int | None, whole: bool = False):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.bytes = self.tokenizer.model, byte_characters()
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.whole = whole
        self.ids, self.starts = array("I"), array("q", [0])

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if _LETTERS.fullmatch(text):
            seen = text if text.isascii() else word.decode("latin-1").translate(self.bytes)
            return [t.id for t in self.model.tokenize(seen)]
        if _SIGN.fullmatch(word) and b"<|" not in word:
            return self._known(word[:-1]) + self._known(word[-1:])
        return self._encode(text)

    def _known(self, word: bytes) -> list[int]:
        n = self[word]
        return self.ids[self.starts[n]:self.starts[n + 1]].tolist()

    def __missing__(self, word: bytes) -> int:
        ids = self._word(word)
        n = self[word] = len(self)
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return n

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The ids of a UTF-8 text (null: empty) and the end id."""
        if not text:
            return self.end
        if self.whole:
            return np.concatenate([np.array(self._encode(text.decode("utf-8", "replace")), np.uint32), self.end])
        if b"<|" not in text:  # special tokens are told from text by their letters' case
            text = text.lower()
        words, out = text.split(), []
        for a in range(0, len(words), WORDS_HELD):
            part = words[a:a + WORDS_HELD]
            if len(self) > WORDS_HELD:  # memory stays bounded
                self.clear()
                self.ids, self.starts = array("I"), array("q", [0])
            n = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            starts = np.frombuffer(self.starts, np.int64)
            first, length = starts[n], starts[n + 1] - starts[n]
            ends = np.cumsum(length)
            take = np.arange(ends[-1]) + np.repeat(first - ends + length, length)
            out.append(np.frombuffer(self.ids, np.uint32)[take] if len(take) else np.zeros(0, np.uint32))
            del starts  # an array that is looked into can't grow
        return np.concatenate([*out, self.end])


# ------------------------------------------------------------------ Spark
def _write(path: str, end_id: int | None, whole: bool, kind: str, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, file, out, size = Encoder(path, end_id, whole), None, [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if file is None:
                file = FileWriter(TaskContext.get().partitionId(), kind, block)
            frames = file.add(key, encode(text.as_py()))
            out += frames
            size += sum(map(len, frames))
            if size >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, size = [], 0
    if file is not None:
        yield pa.RecordBatch.from_arrays([pa.array(out + file.close(), pa.binary())], names=["value"])


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text",
              end_id: int | None = None, whole: bool = False, planes: str = "bit", block: int = BLOCK) -> int:
    """Write the token ids of all ``docs`` below ``path`` in ascending order of ``key``; returns the number of files asked for.

    ``tokenizer`` is the file of a tokenizers vocabulary, at the same place on every machine; ``whole`` says that
    each text must be encoded in one call (see ``Encoder``). Null keys
    come first; rows of one key follow each other by a hash of their texts and the texts; a null text counts
    as empty and has the end id only. Other columns of ``docs`` are not read. Texts are dealt to files by ranges of
    the key, so that each task sorts, encodes and writes one file's documents, block by block. An empty
    table leaves files without documents, or none.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("t"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)).cast("long"))).first()[0] or 0
    spark = docs.sparkSession
    files = max(-(-size // TEXT_BYTES_PER_FILE), spark.sparkContext.defaultParallelism)
    mixed = rows.select("k", "t", F.xxhash64("t").alias("h"))
    placed = mixed.repartitionByRange(files, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    frames = placed.mapInArrow(lambda it: _write(tokenizer, end_id, whole, planes, block, it), "value binary")
    with batches_of(spark, ROWS):
        frames.select(F.col("value").cast("string")).write.option("lineSep", MARK.decode()).text(path)
    return files


IDS = "place long, row long, doc_id long, local long, n_tokens long, ids binary"
_IDS = pa.schema([("place", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()),
                  ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            content = memoryview(batch.column(0)[i].as_buffer())
            if not len(content):
                continue
            facts, nulls, keys, counts, chunks = read_file(content)
            rows, size, local = [], 0, 0
            held = np.zeros(0, "<u4")
            for r in range(len(keys)):
                parts, need = [], int(counts[r])
                while need > 0:
                    if not len(held):
                        held = next(chunks)
                    parts.append(held[:need].tobytes())
                    took = min(need, len(held))
                    held, need = held[took:], need - took
                rows.append((facts["place"], r, None if nulls[r] else int(keys[r]), local, int(counts[r]), b"".join(parts)))
                local += int(counts[r])
                size += 4 * int(counts[r]) + 64
                if size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _IDS, strict=True)], schema=_IDS)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: place (of the file), row (in it), doc_id, local (ids before it in the
    file), n_tokens and ids (unsigned 32-bit little-endian). A damaged file fails the query with a ValueError."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(_read, IDS)


def with_starts(ids: DataFrame, files: DataFrame, n_files: int) -> DataFrame:
    """Add ``start``, the ids of all documents before each one; ``files`` has (place, total) of every file."""
    unit = F.col("place") / F.lit(float(max(1, n_files)))
    before = ranked(files, None, unit, [F.col("place")], n_files, sums={"total": "base"})
    return ids.join(before.select("place", "base"), "place").withColumn("start", F.col("base") + F.col("local"))


def positions(spark: SparkSession, path: str, n_files: int, *digests) -> DataFrame:
    """Rows (doc_id, start, n_tokens and the columns ``digests`` of ids) of the files below ``path``, read once."""
    rows = written(read_ids(spark, path).select("place", "doc_id", "local", "n_tokens", *digests), "ids-read")
    totals = rows.groupBy("place").agg(F.sum("n_tokens").alias("total"))
    return with_starts(rows, totals, n_files).drop("place", "local", "base")
