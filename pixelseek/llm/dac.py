"""Token ids in directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id and a continuation bit for each;
level k + 1 holds the next chunk of those ids whose bit in level k is set, in the same order. A rank directory counts the
set bits before each 512-bit block, so the place of an id's next chunk is one directory entry plus the bits of one block:
any id is found without decoding any other.

File: segments of ``SEGMENT`` ids one after the other, then a directory (document ids, which of them are null, starts of
documents, offsets of segments), its length and a mark. Documents follow one another in ascending id order through files
in the order of their numbers. A segment is all that a writer or reader holds in memory beside the directory.

Files are written through Arrow's file systems to a folder that all executors share, each attempt under a name of its
own; only files that a finished task reports are ever read, so lost executors and repeated attempts do no harm.

Defined cases: a null text is empty and holds the end id alone; null document ids come first; rows of equal id follow
each other by a hash of their text; an empty table gives no document; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseek.llm.common import new_folder
from pixelseek.llm.units import Memory, Units, code_points, in_parts, split_by_text

SEGMENT = 1 << 18
#: Pieces of text that a worker remembers before it starts anew.
REMEMBERED = 3_000_000
#: Characters of texts that are encoded together.
BATCH_CHARS = 1 << 20
MARK = b"DACIDS01"
_BLOCK = 512

Encode = Callable[[list[str]], list[np.ndarray]]


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of chunks, continuation bitmaps and rank directories of an array of uint32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // _BLOCK) * _BLOCK // 8, dtype=np.uint8)
        padded[: len(bitmap)] = bitmap
        ones = np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.uint32)
        rank = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(
            np.array([len(rest)], "<u4").tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + padded.tobytes() + rank.tobytes()
        )
        rest = rest[more] >> 8
        if not len(rest):
            return bytes([len(levels)]) + b"".join(levels)


@dataclass(frozen=True)
class Segment:
    """An encoded segment: per level its chunks, bitmap and rank directory."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def read(cls, data: bytes) -> Segment:
        levels, at = [], 1
        for _ in range(data[0]):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            blocks = -(-n // _BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bitmap = np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, at + 4 + n)
            rank = np.frombuffer(data, "<u4", blocks, at + 4 + n + len(bitmap))
            levels.append((chunks, bitmap, rank))
            at += 4 + n + len(bitmap) + 4 * blocks
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def all(self) -> np.ndarray:
        out, where = np.zeros(len(self), dtype=np.uint32), np.arange(len(self))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def get(self, i: int) -> int:
        """The id at place i, by one byte and one rank per level."""
        out = 0
        for k, (chunks, bitmap, rank) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            within = np.bitwise_count(bitmap[block * _BLOCK // 8 : i >> 3]).sum(dtype=np.int64)
            below = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(rank[block]) + int(within) + below.bit_count()
        return out


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class IdFile:
    """A file of documents' ids, opened for random access."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        tail = self._at(size - 8 - len(MARK), 8 + len(MARK))
        if tail[8:] != MARK:
            raise ValueError(f"not a file of token ids: {path}")
        length = int.from_bytes(tail[:8], "little")
        directory = self._at(size - 8 - len(MARK) - length, length)
        docs, segments = np.frombuffer(directory, "<u8", 2).tolist()
        self.doc_ids = np.frombuffer(directory, "<i8", docs, 16)
        self.nulls = np.frombuffer(directory, np.uint8, docs, 16 + 8 * docs)
        self.starts = np.frombuffer(directory, "<u8", docs + 1, 16 + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(directory, "<u8", segments + 1, 24 + 17 * docs).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def segment(self, k: int) -> Segment:
        return Segment.read(self._at(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])))

    def get(self, i: int) -> int:
        """Any id of the file."""
        return self.segment(i // SEGMENT).get(i % SEGMENT)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, segment after segment."""
        held, first, last = np.zeros(0, np.uint32), 0, 0
        for d in range(len(self.doc_ids)):
            a, b = int(self.starts[d]), int(self.starts[d + 1])
            parts = [held[a - first : b - first]]
            while last < b:
                held = self.segment(last // SEGMENT).all()
                first, last = last, last + len(held)
                parts.append(held[max(a - first, 0) : b - first])
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def close(self) -> None:
        self.file.close()


def write_file(path: str, documents: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Number of documents and ids written."""
    system, name = _open(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    doc_ids, nulls, starts, offsets = array("q"), array("B"), array("Q", [0]), array("Q", [0])
    with system.open_output_stream(name) as out:
        held: list[np.ndarray] = []
        size = 0

        def flush(n: int) -> None:
            nonlocal held, size
            ids = np.concatenate(held)
            data = encode_segment(ids[:n])
            out.write(data)
            offsets.append(offsets[-1] + len(data))
            held, size = [ids[n:]], size - n

        for doc_id, ids in documents:
            doc_ids.append(0 if doc_id is None else doc_id)
            nulls.append(doc_id is None)
            starts.append(starts[-1] + len(ids))
            held.append(ids)
            size += len(ids)
            while size >= SEGMENT:
                flush(SEGMENT)
        if size:
            flush(size)
        directory = b"".join(
            np.array(a, dtype=t).tobytes()
            for a, t in (
                ([len(doc_ids), len(offsets) - 1], "<u8"),
                (doc_ids, "<i8"),
                (nulls, np.uint8),
                (starts, "<u8"),
                (offsets, "<u8"),
            )
        )
        out.write(directory + len(directory).to_bytes(8, "little") + MARK)
    return len(doc_ids), int(starts[-1])


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a letter: printable bytes as themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


# Classes of code points for the tokenizer's cut rule; around those of class ODD nothing is cut here.
_ODD, _LETTER, _NUMBER, _SIGN, _SPACE, _EDGE = range(6)


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    found = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.array([_ODD if c == "Cn" else kind.get(c[0], _SIGN) for c in found], dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    # An apostrophe may begin a contraction; of the four separators some rules say blank, some not.
    out[[ord("'"), 0x1C, 0x1D, 0x1E, 0x1F]] = _ODD
    return out


class ByteBpe:
    """A byte-level BPE of the tokenizers library that encodes each different piece of a worker's texts once.

    The tokenizer's own rule cuts a text before it merges: runs of letters, of numbers and of signs, each with one blank
    before it. Texts are cut at those of its borders that neighbouring characters alone decide. A piece that is one run
    goes to the library's model, any other (contractions, runs of blanks) through the whole tokenizer. A worker forgets
    its pieces beyond ``REMEMBERED`` of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text that holds the string of an added token is encoded by the library as a whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.spelling = dict(enumerate(_byte_letters()))
        self.memory = Memory(REMEMBERED)

    def _cuts(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of pieces; ``ends`` of the texts."""
        here = _classes()[cps]
        filled = np.flatnonzero(np.diff(ends, prepend=0))
        first, last = np.append(0, ends[:-1])[filled], ends[filled] - 1
        before, after = np.roll(here, 1), np.roll(here, -1)
        before[first], after[last] = _EDGE, _EDGE
        before_that = np.roll(before, 1)
        before_that[first] = _EDGE

        def run(c: np.ndarray) -> np.ndarray:
            return (c >= _LETTER) & (c <= _SIGN)

        blank = cps == ord(" ")
        cut = (here != before) & run(here) & run(before)
        # One blank or line end between two runs; a blank goes with what follows.
        cut |= (here == _SPACE) & run(before) & run(after)
        cut |= run(here) & (before == _SPACE) & run(before_that) & ~np.roll(blank, 1)
        cut[first] = True
        return np.flatnonzero(cut)

    def _learn(self, units: Units, new: np.ndarray) -> None:
        numbers, odd, ids, sizes = [], [], array("I"), []
        for k in new.tolist():
            unit = units.text(k)
            body = unit[1:] if unit[0] == " " else unit
            kinds = {_LETTER} if body.isalpha() else set(_classes()[code_points(body)].tolist())
            if len(kinds) == 1 and kinds <= {_LETTER, _NUMBER, _SIGN}:
                spelled = unit.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelling)
                tokens = self.model.tokenize(spelled)
                ids.extend([t.id for t in tokens])
                sizes.append(len(tokens))
                numbers.append(k)
            else:
                odd.append((k, unit))
        whole = self.tokenizer.encode_batch_fast([u for _, u in odd], add_special_tokens=False)
        for (k, _), e in zip(odd, whole):
            ids.extend(e.ids)
            sizes.append(len(e.ids))
            numbers.append(k)
        self.memory.add(units, np.array(numbers), np.frombuffer(ids, np.uint32), np.array(sizes))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        marked = [any(a in t for a in self.added) for t in texts]
        plain = iter(self._plain([t for t, m in zip(texts, marked) if not m]))
        whole = iter(
            self.tokenizer.encode_batch_fast([t for t, m in zip(texts, marked) if m], add_special_tokens=False)
        )
        return [np.array(next(whole).ids, dtype=np.uint32) if m else next(plain) for m in marked]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        cps = code_points("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        if not len(cps):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        starts = self._cuts(cps, ends)
        units = Units(cps, starts)
        new = self.memory.missing(units)
        if len(new):
            self._learn(units, new)
        ids, stops = self.memory.gather(units)
        return split_by_text(ids.view(np.uint32), stops, starts, ends)


@functools.lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """The worker's encoder, which remembers pieces from one task to the next."""
    return ByteBpe(path)


def write_ids(docs: DataFrame, encoder: Callable[[], Encode], end_id: int, folder: str | None = None) -> DataFrame:
    """Encode texts and write the files; returns the manifest (path, first, docs, ids), first: ids in earlier files."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], np.uint32)

        def documents(first: pd.DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
            encode = encoder()
            for batch in _chain(first, batches):
                rows = zip(batch["doc_id"].to_list(), batch["missing"].to_list())
                for part in in_parts(batch["text"].to_list(), BATCH_CHARS):
                    # The texts' rows come in the same order.
                    for tokens, (doc_id, none) in zip(encode(part), rows):
                        yield None if none else int(doc_id), np.concatenate((tokens, end))

        for first in batches:
            if len(first):
                path = f"{folder}/{uuid.uuid4().hex}.dac"
                n, ids = write_file(path, documents(first))
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "path": [path], "docs": [n], "ids": [ids]})

    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        F.col("doc_id").isNull().alias("missing"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id"), F.col("missing").desc(), F.col("h")]
    # One row per file reaches the driver.
    done = (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInPandas(write, "part int, path string, docs long, ids long")
        .collect()
    )
    manifest, first = [], 0
    for r in sorted(done, key=lambda r: r["part"]):
        manifest.append((r["path"], first, r["docs"], r["ids"]))
        first += r["ids"]
    return spark.createDataFrame(manifest, "path string, first long, docs long, ids long")


def _chain(first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield from rest


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document; ids as little-endian unsigned 32-bit integers."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first in zip(batch["path"], batch["first"]):
                file = IdFile(path)
                rows, size = [], 0
                for d, ids in enumerate(file.documents()):
                    doc_id = None if file.nulls[d] else int(file.doc_ids[d])
                    rows.append((doc_id, first + int(file.starts[d]), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size >= SEGMENT:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)
                file.close()

    n = max(1, manifest.count())
    return manifest.select("path", "first").repartition(n, "path").mapInPandas(
        read, "doc_id long, start long, ids binary"
    )


def _rows(rows: list[tuple]) -> pd.DataFrame:
    doc_ids, starts, ids = zip(*rows)
    return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": starts, "ids": ids})
