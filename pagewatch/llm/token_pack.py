"""Token ids as bit-packed binary shards.

A shard file holds the ids of its documents one after another, each in the fewest bits
that hold the vocabulary, in blocks of a fixed number of ids. Eight ids of ``w`` bits
fill ``w`` bytes, so packing and unpacking are a few column operations in numpy on
whole blocks. A table of block offsets gives random access.

File: magic, blocks, block offsets (<u8, one more than blocks), document ids (<i8), their
null flags (u1), their token counts (<u8), and the tail (<QIIQQ: ids, bits, ids a block,
documents, place of the block offsets; then the magic again).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewatch.llm.tables import whole_text
from pagewatch.session import scratch_root, write_through

MAGIC = b"PACKED1\n"
TAIL = struct.Struct("<QIIQQ")
BLOCK = 65_536
END_ID = 0
VOCABULARY = 50_257
TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 600_000
ENDS = frozenset(".,;:!?")
SPACES = re.compile(r" \s")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide fields, low bits first; the last byte is padded with zeros."""
    eights = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    eights.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(eights), bits), np.uint8)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        field = eights[:, lane] << np.uint64(shift)
        for at in range(first, (lane * bits + bits - 1) // 8 + 1):
            out[:, at] |= (field >> np.uint64(8 * (at - first))).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The ``count`` ids packed in ``data``."""
    rows = -(-count // 8)
    raw = np.zeros(rows * bits, np.uint8)
    used = -(-count * bits // 8)
    raw[:used] = np.frombuffer(data, np.uint8, used)
    raw = raw.reshape(rows, bits)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(8):
        first, shift = divmod(lane * bits, 8)
        field = np.zeros(rows, np.uint64)
        for at in range(first, (lane * bits + bits - 1) // 8 + 1):
            field |= raw[:, at].astype(np.uint64) << np.uint64(8 * (at - first))
        out[:, lane] = (field >> np.uint64(shift)) & mask
    return out.reshape(-1)[:count]


class ShardWriter:
    """Appends documents to an open binary file; holds less than a block of ids."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.at = len(MAGIC)
        self.offsets, self.docs, self.nulls, self.counts = [self.at], [], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= 16 * self.block:
            self._drain(self.held - self.held % self.block)

    def _drain(self, upto: int) -> None:
        joined = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for start in range(0, upto, self.block):
            data = pack(joined[start : min(start + self.block, upto)], self.bits)
            self.sink.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [joined[upto:]], len(joined) - upto

    def finish(self) -> None:
        """Write the rest, the tables and the tail."""
        self._drain(self.held)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.docs, "<i8").tobytes())
        self.sink.write(np.array(self.nulls, "u1").tobytes())
        self.sink.write(np.array(self.counts, "<u8").tobytes())
        self.sink.write(TAIL.pack(self.ids, self.bits, self.block, len(self.docs), self.at) + MAGIC)


class Shard:
    """Reads a shard file: its documents, or any run of ids."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - TAIL.size - len(MAGIC))
        tail = source.read(TAIL.size + len(MAGIC))
        if tail[TAIL.size :] != MAGIC:
            raise ValueError("not a packed shard")
        self.n_ids, self.bits, self.block, n_docs, table = TAIL.unpack(tail[: TAIL.size])
        source.seek(table)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8")
        self.docs = np.frombuffer(source.read(8 * n_docs), "<i8")
        self.nulls = np.frombuffer(source.read(n_docs), "u1").astype(bool)
        self.counts = np.frombuffer(source.read(8 * n_docs), "<u8").astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from number ``start`` of the shard; only the blocks they lie in are read."""
        if count <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, got = int(self.offsets[first]), []
        for b in range(first, last + 1):
            held = min(self.block, self.n_ids - b * self.block)
            got.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], held, self.bits))
        return np.concatenate(got)[start - first * self.block :][:count]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of each document, reading ahead many blocks at a time."""
        ahead, held_from, at = np.empty(0, np.uint32), 0, 0
        for doc, null, count in zip(self.docs.tolist(), self.nulls.tolist(), self.counts.tolist()):
            if at + count > held_from + len(ahead):
                ahead, held_from = self.ids(at, min(max(count, 32 * self.block), self.n_ids - at)), at
            yield None if null else doc, at, ahead[at - held_from : at - held_from + count]
            at += count


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordEncoder(dict):
    """Whole texts to ids with the tokenizers library, each different word encoded once.

    The byte-level tokenizer's pattern starts a new piece at a space that stands before
    another character, so pieces cut there are encoded alike on their own. A piece of plain
    characters is cut by that pattern and goes straight to the library's merges; any other
    piece, and every text that spells out a special token, takes the library's whole way.
    The cache maps a word, without the space before it, to the bytes of its ids.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__()
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters, self.inner = byte_letters(), {}
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.is_plain = regex.compile(r"[\p{L}\p{N}\p{P}\p{S} \n\r\t]*").fullmatch

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        stem, mark = word[:-1], word[-1:]
        if word.isalpha():
            ids = self._merged(" " + word)
        elif mark in ENDS and stem.isalpha():
            ids = self[stem] + self._inside(mark)
        else:
            ids = self._lines(word)
        if len(word) <= 64:
            self[word] = ids
        return ids

    def _lines(self, word: str) -> bytes:
        """A word whose plain parts may stand on lines of their own: a line end before a letter is a piece."""
        before, line_end, after = word.partition("\n")
        if not (line_end and before and before[-1] in ENDS and before[:-1].isalpha() and after):
            return self._cut(" " + word)
        if after.isalpha():
            return self[before] + self._inside("\n") + self._inside(after)
        if after[-1] in ENDS and after[:-1].isalpha():
            return self[before] + self._inside("\n") + self._inside(after[:-1]) + self._inside(after[-1])
        return self._cut(" " + word)

    def _cut(self, text: str) -> bytes:
        if not self.is_plain(text):
            return self._whole(text)
        parts = self.pieces(text)
        if len(parts) == 1:
            return self._merged(text)
        return b"".join([self[p[1:]] if p[0] == " " and len(p) > 1 else self._inside(p) for p in parts])

    def _inside(self, piece: str) -> bytes:
        """The ids of a piece without a space before it, kept while there is room."""
        ids = self.inner.get(piece)
        if ids is None:
            ids = self._merged(piece)
            if len(self.inner) >= self.limit // 4:
                self.inner.clear()
            if len(piece) <= 64:
                self.inner[piece] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.frombuffer(self._whole(text), "<u4")
        first, *words = text.split(" ")
        if text.endswith(" ") or SPACES.search(text):  # white space beside a space: a run stays in one piece
            first, *words = self._runs([first, *words])
        return np.frombuffer(self._cut(first) + b"".join(map(self.__getitem__, words)), "<u4")

    @staticmethod
    def _runs(words: list[str]) -> list[str]:
        joined = words[:1]
        for word in words[1:]:
            if word and not word[0].isspace():
                joined.append(word)
            else:
                joined[-1] = f"{joined[-1]} {word}"
        return joined


@lru_cache(1)
def encoder_for(path: str) -> WordEncoder:
    """One encoder per Python worker, so its words serve all tasks of the worker."""
    return WordEncoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def open_shared(folder: str):
    """The file system of a shared folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str | None = None, vocabulary: int = VOCABULARY, end_id: int = END_ID,
    block: int = BLOCK,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into shard files; returns their list.

    Null texts count as empty and give the end id alone. A null doc_id comes first.
    Repeated rows are encoded once each. A shard is written under a name of its attempt
    and renamed when complete, so a lost executor leaves no half shard behind. One row
    per shard: shard, path, n_docs, n_ids.
    """
    path, bits = tokenizer or tokenizer_path(), bits_for(vocabulary)
    ordered = docs.select("doc_id", whole_text().alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, encoder, writer = TaskContext.get().partitionId(), encoder_for(path), None
        files, root = open_shared(folder)
        end = np.array([end_id], "<u4")
        files.create_dir(root, recursive=True)
        name, attempt = f"{root}/shard-{shard:06d}.bin", f"{root}/.{uuid.uuid4().hex}.part"
        for batch in batches:
            for doc_id, text in zip(batch.doc_id, batch.text):
                if writer is None:
                    sink = files.open_output_stream(attempt)
                    writer = ShardWriter(sink, bits, block)
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([encoder.encode(text), end]))
        if writer is None:
            return
        writer.finish()
        sink.close()
        files.move(attempt, name)
        yield pd.DataFrame(
            {"shard": [shard], "path": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}
        ).astype({"shard": "int64"})

    return ordered.mapInPandas(encode, "shard long, path string, n_docs long, n_ids long")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The list of shards has a row per file; only it is summed in one place.
    """
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = open_shared(folder)
        for batch in batches:
            for path, base in zip(batch.path, batch.base):
                with files.open_input_file(path) as source:
                    found = [
                        (doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, at, ids in Shard(source)
                    ]
                out = pd.DataFrame(found, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    return placed.repartitionByRange(n, "shard").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the shards to the shared scratch folder, then read them back."""
    folder = f"{scratch_root(spark)}/pagewatch-shards-{uuid.uuid4().hex}"
    return read_shards(write_through(write_shards(docs, folder), "shards"), folder)
