"""Token ids in binary files, compressed by a grammar per shard.

Documents are put in order of their ids by a range shuffle of the texts, encoded, and written as files of at most FILE_IDS ids and one document's more. A file is a sequence of shards of
SHARD ids, each a Re-Pair grammar (``repair``), then the index: of each document its key, its first id's place in the file and its number of ids, and of each shard
where its bytes begin and its first id's place. So a document, or any range of ids, is read by decoding the symbols it lies in.
"""

from __future__ import annotations

import codecs
import functools
import io
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repair
from .common import shared_dir, stored

MAGIC = b"TOKG"
END_ID = 2
SHARD = 1 << 20  # ids
FILE_IDS = 1 << 23
MOST_WORDS = 500_000  # words, and parts of words, that a Python worker keeps encoded, twice as many at most
PIECE = 1 << 23  # characters that are looked at together


SLICE = 2048  # texts that are encoded together at most

BORDER = re.compile(r"(?<=\S)[ \t\n]")
BLOCK = 64  # pieces that the library encodes as one text

# Bytes by kind; the last kind, of all bytes that are not here, says nothing
LETTER, DIGIT, SIGN, QUOTE, BLANK, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((LETTER, [*range(65, 91), *range(97, 123)]), (DIGIT, range(48, 58)), (SIGN, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), (QUOTE, [39]), (BLANK, [*range(9, 14), 32])):
    KIND[_bytes] = _kind
# Kinds of two neighbours between which a text may be cut: no part of the byte-level pattern has both
APART = np.zeros((6, 6), bool)
for _left, _rights in ((LETTER, [DIGIT, SIGN, QUOTE, BLANK]), (DIGIT, [LETTER, SIGN, QUOTE, BLANK]), (SIGN, [LETTER, DIGIT, BLANK]), (QUOTE, [DIGIT, BLANK]), (OTHER, [BLANK])):
    APART[_left, _rights] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 ``data`` may be cut: between letters up to U+027F, digits and signs of ASCII, before white space that follows a visible character, and behind a line feed between two visible ones."""
    kind = KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    after = data[lead + 1]
    lead = lead[(data[lead] != 0xC3) | (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    apart = APART.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    line = np.flatnonzero(data[1:-1] == 10) + 1
    apart[line[(kind[line - 1] < BLANK) & (kind[line + 1] < BLANK)]] = True
    at = np.flatnonzero(apart) + 1
    wide = at[kind[at - 1] == OTHER]  # what ends there may be white space beyond ASCII, or a control character
    if not len(wide):
        return at
    a, b, c = data[np.maximum(wide - 3, 0)], data[np.maximum(wide - 2, 0)], data[wide - 1]
    space = (c < 0x80) | (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    space |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    keep = np.ones(len(at), bool)
    keep[kind[at - 1] == OTHER] = ~space
    return at[keep]


# Character of the byte-level alphabet for each byte
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_hidden = iter(range(256, 512))
ALPHABET = "".join(chr(b if b in SHOWN else next(_hidden)) for b in range(256))

# Bytes of ASCII letters and of the letters U+00C0 to U+027F; 0xD7 and 0xF7 of these are signs
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True


def are_letters(pieces: list[bytes]) -> np.ndarray:
    """Which of the UTF-8 ``pieces`` are such letters only, after a blank or none: each is one part of the byte-level pattern."""
    data = np.frombuffer(b"".join(pieces) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    starts = np.concatenate([[0], ends[:-1]])
    other = ~LETTERS[data]
    other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    other[starts[(data[starts] == 32) & (ends > starts + 1)]] = False
    before = np.concatenate([[0], np.cumsum(other)])
    return (before[ends] == before[starts]) & (ends > starts)


PLAIN = re.compile(rb" ?[!-~]+").fullmatch


def one_word(text: str) -> bool:
    """Whether ``text`` has no white space, but for a blank before it."""
    words = text.split()
    return len(words) == 1 and len(words[0]) + (text[0] == " ") == len(text)


class Kept:
    """Encoded strings, the most recent ``most`` to 2 * ``most`` of them."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def find(self, words: list[bytes]) -> tuple[list[bytes | None], list[int]]:
        """What is kept of each, and the places of those that aren't; what is found in the older half moves to the younger."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        found, missing = list(map(self.young.get, words)), []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            if (ids := self.old.get(words[k])) is None:
                missing.append(k)
            else:
                found[k] = self.young[words[k]] = ids
        return found, missing


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, each distinct piece encoded once, by the library, and looked up afterwards.

    Byte-level vocabularies split a text by a pattern before they merge, so a text may be cut wherever no part of that pattern can go on (``cuts``). Special tokens' names in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        state = json.loads(self.tokenizer.to_str())
        pre = state["pre_tokenizer"] or {}
        self.by_words = state["normalizer"] is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and all(t["special"] for t in state["added_tokens"])
        self.words = self.parts = Kept(MOST_WORDS)
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.by_words and len(line) == 1 else None
        model, vocabulary = state["model"], self.tokenizer.get_vocab(with_added_tokens=False)
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")]
        self.plain = None
        if self.by_words and model["type"] == "BPE" and not any(odd) and all(c in vocabulary for c in ALPHABET):
            self.plain = Tokenizer(self.tokenizer.model)  # takes words in the byte-level alphabet, line by line
            self.plain.pre_tokenizer = CharDelimiterSplit(ALPHABET[10])
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes] | None:
        """The library's ids of words that its pattern would not cut (``are_letters``), by its model alone; how many bytes each id stands for says where a word ends."""
        lines = [codecs.charmap_decode(b"\n".join(words[k : k + BLOCK]), "strict", ALPHABET)[0] for k in range(0, len(words), BLOCK)]
        ids = array("I")
        for e in self.plain.encode_batch_fast(lines, add_special_tokens=False):
            ids.extend(e.ids)
        held = ids.tobytes()
        till = np.cumsum(self.bytes_of[np.frombuffer(held, "<u4")])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at = np.searchsorted(till, ends)
        if not len(till) or till[-1] != ends[-1] or not np.array_equal(till[at], ends):
            return None
        marks = [0, *(4 * (at + 1)).tolist()]
        return [held[a:b] for a, b in zip(marks, marks[1:])]

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The library's ids; words of letters go to its model, all else through its pattern."""
        chosen = are_letters(pieces) if self.plain is not None and pieces else np.zeros(len(pieces), bool)
        words, rest = np.flatnonzero(chosen).tolist(), np.flatnonzero(~chosen).tolist()
        known = self._words([pieces[k] for k in words]) if words else []
        if known is None:
            return self._by_lines(pieces)
        out: list[bytes] = [b""] * len(pieces)
        for k, ids in zip(words + rest, known + self._by_lines([pieces[k] for k in rest])):
            out[k] = ids
        return out

    def _by_lines(self, pieces: list[bytes]) -> list[bytes]:
        """The library's ids. Pieces without white space, but for a blank before them, stand line by line in one text, which costs less; the pattern cuts at such a line's ends."""
        lines = [k for k, p in enumerate(pieces) if PLAIN(p) or one_word(p.decode())] if self.line is not None else []
        out: list[bytes | None] = [None] * len(pieces)
        blocks = [lines[k : k + BLOCK] for k in range(0, len(lines), BLOCK)]
        for block, found in zip(blocks, self.library([b"\n".join([pieces[k] for k in block]).decode() for block in blocks])):
            ends = np.append(np.flatnonzero(np.frombuffer(found, "<u4") == self.line), len(found) // 4).tolist()
            if len(ends) == len(block):
                low = 0
                for k, end in zip(block, ends):
                    out[k] = found[4 * low : 4 * end]
                    low = end + 1
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.library([pieces[k].decode() for k in rest])):
            out[k] = ids
        return out

    def _distinct(self, pieces: list[bytes]) -> list[bytes]:
        found, missing = self.words.find(pieces)
        for k, ids in zip(missing, self._learn([pieces[k] for k in missing])):
            found[k] = self.words.young[pieces[k]] = ids
        return found

    def _together(self, texts: list[str]) -> list[bytes]:
        """The texts are cut by numpy, each distinct piece is looked up once, and the pieces' ids are gathered by numpy."""
        whole = pa.array(texts, pa.large_binary())
        bounds = np.frombuffer(whole.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts(data)] = begins[bounds] = True
        at = np.flatnonzero(begins)  # the end of the data is the last
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), whole.buffers()[2] or pa.py_buffer(b"")]).dictionary_encode()
        names = pieces.dictionary
        marks = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1].tolist()
        held = (names.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        ids = self._distinct([held[a:b] for a, b in zip(marks, marks[1:])])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, piece = np.frombuffer(b"".join(ids), "<u4"), pieces.indices.to_numpy()
        n = sizes[piece]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[piece] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        marks = np.append(0, ends)[np.searchsorted(at, bounds)].tolist()
        return [out[a:b].tobytes() for a, b in zip(marks, marks[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts of any length are looked at about ``PIECE`` characters at a time."""
        if not self.by_words:
            return self.library(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, str]] = []
        room = PIECE

        def flush() -> None:
            for (k, _), ids in zip(held, self._together([t for _, t in held])):
                out[k].append(ids)
            held.clear()

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                border = BORDER.search(text, at + PIECE) if len(text) - at > PIECE else None
                end = border.start() if border else len(text)
                held.append((k, text[at:end]))
                room -= end - at
                at = end
                if room <= 0:
                    flush()
                    room = PIECE
        if held:
            flush()
        return [b"".join(pieces) for pieces in out]


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker: what it knows serves the worker's next tasks."""
    return Encoder(path)


class Writer:
    """One file: shards as they fill up, then the index."""

    def __init__(self, out: io.RawIOBase, shard: int = SHARD):
        self.out, self.shard, self.at, self.ids, self.held, self.n_held = out, shard, len(MAGIC), 0, [], 0
        self.docs: list[tuple[int | None, int, int]] = []
        self.shards: list[tuple[int, int]] = []
        out.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        """``ids`` as little-endian 32-bit bytes."""
        n = len(ids) // 4
        self.docs.append((key, self.ids, n))
        self.held.append(ids)
        self.ids, self.n_held = self.ids + n, self.n_held + n
        if self.n_held >= self.shard:
            rest = np.frombuffer(b"".join(self.held), "<u4")
            while len(rest) >= self.shard:
                self._shard(rest[: self.shard])
                rest = rest[self.shard :]
            self.held, self.n_held = [rest.tobytes()], len(rest)

    def _shard(self, ids: np.ndarray) -> None:
        data = repair.to_bytes(repair.build(ids, least=2, rounds=None))
        self.shards.append((self.at, len(self.shards) * self.shard))
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)."""
        if self.n_held:
            self._shard(np.frombuffer(b"".join(self.held), "<u4"))
        index = struct.pack("<2q", len(self.docs), len(self.shards))
        index += np.array([[key is not None, key or 0, start, n] for key, start, n in self.docs], "<i8").tobytes() + np.array(self.shards, "<i8").tobytes()
        self.out.write(index + struct.pack("<q", self.at))
        return len(self.docs), self.ids, self.at + len(index) + 8


class Reader:
    """A file's index, and its ids in whole or in part."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        if source.read_at(4, 0) != MAGIC:
            raise ValueError("not a token file")
        (self.end,) = struct.unpack("<q", source.read_at(8, size - 8))
        index = source.read_at(size - 8 - self.end, self.end)
        n, shards = struct.unpack("<2q", index[:16])
        self.docs = np.frombuffer(index, "<i8", 4 * n, 16).reshape(-1, 4)  # key is there, key, start, ids
        self.shards = np.frombuffer(index, "<i8", 2 * shards, 16 + 32 * n).reshape(-1, 2)  # first byte, start

    def keys(self) -> list[int | None]:
        return [k if there else None for there, k in self.docs[:, :2].tolist()]

    def shard(self, k: int) -> tuple[repair.Grammar, np.ndarray]:
        end = int(self.shards[k + 1, 0]) if k + 1 < len(self.shards) else self.end
        return repair.from_bytes(self.source.read_at(end - int(self.shards[k, 0]), int(self.shards[k, 0])))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only shards and symbols that they lie in are decoded."""
        out, k = [np.zeros(0, np.uint32)], int(np.searchsorted(self.shards[:, 1], start, "right")) - 1
        while start < stop and k < len(self.shards):
            first = int(self.shards[k, 1])
            till = min(stop, int(self.shards[k + 1, 1]) if k + 1 < len(self.shards) else stop)
            out.append(repair.access(*self.shard(k), start - first, till - first))
            start, k = till, k + 1
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(key, place of the first id, the ids piece by piece) of all documents in order; each shard is decoded once and one is held at a time."""
        k, low, high, ids = -1, 0, 0, np.zeros(0, np.uint32)
        for there, key, start, n in self.docs.tolist():
            pieces, at = [], start
            while at < start + n:
                if at >= high:
                    k, low = k + 1, high
                    g, _ = self.shard(k)
                    ids = repair.expand(g, g.sequence)
                    high = low + len(ids)
                pieces.append(ids[at - low : min(start + n, high) - low])
                at += len(pieces[-1])
            yield key if there else None, start, pieces


MANIFEST = "part int, number int, file string, docs long, ids long, bytes long"


def write_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS, shard: int = SHARD) -> DataFrame:
    """Writes the ids of all texts, each with ``end_id`` behind it, below ``path`` in ascending order of the ids, and returns the manifest (``MANIFEST``, in the order of part and number).

    Null ids come first, rows that repeat an id are in the order of their texts' hashes and are all written; null texts are empty. ``tokenizer`` is a file that all executors have. Texts are shuffled once, by
    ranges of id, hash and row number, so no id can fill a task. Only one shard's ids and one text's are in memory at a time. Other columns don't count, an empty table gives an empty manifest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("tie"), text.alias("text"))
    order = [F.col("key").asc_nulls_first(), F.col("th"), F.col("tie")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = encoder_of(tokenizer), TaskContext.get()
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        done: list[tuple] = []
        writer = name = None
        slices = (b.slice(low, SLICE).columns for b in batches for low in range(0, b.num_rows, SLICE))
        rows = ((k, ids) for keys, texts in slices for k, ids in zip(keys.to_pylist(), encoder.encode(texts.to_pylist())))

        def close() -> None:
            nonlocal writer
            if writer is not None:
                done.append((context.partitionId(), len(done), name, *writer.close()))
                writer.out.close()
                writer = None

        for key, ids in rows:
            if writer is None:
                name = f"part-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.tok"  # the manifest names those of attempts that succeeded
                writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), shard)
            writer.add(key, ids + end)
            if writer.ids >= file_ids:
                close()
        close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    return spread.mapInArrow(run, MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``first``, the ids in all files before it. Collects one sum per part, of which there are as many as shuffle partitions."""
    sums = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    spark = manifest.sparkSession
    starts = spark.createDataFrame(before, "part int, before long")
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(F.broadcast(starts), "part").withColumn("first", F.col("before") + F.coalesce(F.sum("ids").over(own), F.lit(0))).drop("before")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document in ``files`` (file, first), decoded from the bytes on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{base}/{name}") as source:
                    out = []
                    for key, start, pieces in Reader(source).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.astype("<u4", copy=False).data, crc)
                        out.append((key, first + start, sum(map(len, pieces)), crc))
                        if len(out) == 10_000:
                            yield pack(out)
                            out = []
                    yield pack(out)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["key", "start", "n_tokens", "ids_crc32"])

    n = files.count()
    return files.select("file", "first").repartition(max(1, min(n, 20_000))).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Writes the ids of ``docs`` to fresh files in the shared folder and returns what the files hold: doc_id, start, n_tokens, ids_crc32. Cases as in ``write_files``."""
    path = shared_dir(docs.sparkSession, "tokens")
    manifest = stored(write_files(docs, path, tokenizer, id_col, text_col, **sizes), "token-files")
    return read_files(docs.sparkSession, path, with_starts(manifest)).withColumnRenamed("key", "doc_id")
