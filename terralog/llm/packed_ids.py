"""Token ids in binary files of patched frame-of-reference blocks.

Ids are cut into blocks of ``BLOCK``.  A block stores its minimum, then every id less the
minimum in as many bits as ``PERCENTILE`` of its ids need; the few that need more go to an
exception list of positions and full values.  An index holds where each block starts, so
any block can be read alone.  Integers are little-endian:

    "PFOR" 1u4 | documents u8 | ids u8 | blocks u8
    block starts u8 x (blocks + 1)          from the first block on
    ids per document u8 x documents
    document ids i8 x documents, then a byte each: 1 where the document id is null
    blocks: minimum u4, width u1, exceptions u1 (count), packed bits, positions u1, values u4
    crc32 u4 of everything before

Documents are put in ascending id order by a range shuffle (null first, rows of one id in
input order, spread over tasks if they are many).  A task encodes its range and writes a
file whenever ``file_ids`` ids have come together, below the cluster's shared folder; the
rows it returns name the files.  That manifest is stored, and only files named in it are
read, so a file left by a lost or doubled task is never seen.

Defined results: a null text counts as empty and has the end id alone; every input row is
one document; an empty table gives no file and no row; a very long text is encoded whole
and may make a file larger than ``file_ids``; ids are read as longs, and one that is no
number raises; extra columns are left alone.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.llm.common import stored
from terralog.sources.shared import shared_path

BLOCK, PERCENTILE = 128, 0.9
FILE_IDS = 4_000_000
END_ID = 1
#: Bounds of what a task remembers: chunks and pieces, and characters of one.
MOST_WORDS, LONGEST_KEPT = 400_000, 64
TEXT_AT_ONCE = 2_000_000
MAGIC = struct.pack("<4sI", b"PFOR", 1)
AT_ONCE = 4096  # blocks packed or unpacked in one go


#: Texts of ASCII and composed Latin letters: what the tokenizer's first steps do to them
#: is to make letters small and to cut as below, so pieces can be found without it.
SIMPLE = re.compile("[\x00-\x7f\u00c0-\u012f\u0131-\u017f]*")
LETTERS = "a-zß-öø-ſ"
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \\t\\n\\r\\x0b\\x0c{LETTERS}0-9]+")
#: Byte-level models write each byte as a letter: printable Latin-1 ones as they are, the
#: rest, in order, as the letters from U+0100 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - PRINTABLE))}
SPECIAL = "<|"  # special tokens begin so; they are found in the text as it is
#: What a tokenizer's file must say for texts to be cut as above.
STEPS = {
    "truncation": None,
    "padding": None,
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: And of each special token, besides how it begins.
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


class WordIds:
    """Ids of texts by the tokenizers library, remembering what a chunk of text gave.

    A tokenizer of these ``STEPS`` drops white space and never joins across it or across
    the pieces it cuts first, so a text's ids are those of its chunks between ASCII white
    space, one after the other, and a chunk's are those of its pieces where they are plain
    to see.  Each distinct chunk of the texts at hand is looked up once.
    """

    at_once = 16_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # What was used lately, and what was before that memory was last full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = cut.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self.chunk_ids(distinct), pa.large_binary()).take(chunks.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[cut.offsets.to_numpy()].tolist()
        whole = memoryview(data or b"")
        return [whole[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of these distinct chunks."""
        out = list(map(self.known.get, chunks))
        new = [k for k, ids in enumerate(out) if ids is None]
        if len(self.known) + len(new) > MOST_WORDS:
            self.older, self.known = self.known, {x: ids for x, ids in zip(chunks, out, strict=True) if ids is not None}
        known, older, uncut = self.known, self.older, []
        for k in new:
            chunk = chunks[k]
            ids = older.get(chunk)
            if ids is None:
                if chunk.isascii() and chunk.isalpha():
                    ids = self.piece_ids(chunk.lower())
                elif SIMPLE.fullmatch(chunk) and SPECIAL not in chunk:
                    ids = b"".join(map(self.piece_ids, PIECES.findall(chunk.lower())))
                else:
                    uncut.append(k)
                    continue
            out[k] = ids
            if len(chunk) <= LONGEST_KEPT:
                known[chunk] = ids
        made = self.tokenizer.encode_batch_fast([chunks[k] for k in uncut], add_special_tokens=False)
        for k, got in zip(uncut, made, strict=True):
            out[k] = ids = array("I", got.ids).tobytes()
            if len(chunks[k]) <= LONGEST_KEPT:
                known[chunks[k]] = ids
        return out

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece, whose letters are small."""
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            letters = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        if len(piece) <= LONGEST_KEPT:
            self.known[piece] = ids
        return ids


def in_parts(column: pa.Array, most: int) -> Iterator[list[str]]:
    """The texts of a column, about ``most`` characters at a time."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py())
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class WholeIds:
    """Ids of whole texts by the tokenizers library, for files of any other make."""

    at_once = TEXT_AT_ONCE

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", got.ids).tobytes() for got in made]


def in_words(spec: dict) -> bool:
    """Whether the tokenizer of this file cuts texts as ``WordIds`` does."""
    tokens = spec.get("added_tokens") or []
    return (
        all(spec.get(name) == asked for name, asked in STEPS.items())
        and all(t["content"].startswith(SPECIAL) and PLAIN_TOKEN.items() <= t.items() for t in tokens)
        and not any(x.isspace() for t in tokens for x in t["content"])
        and spec["model"]["type"] == "BPE"
    )


@lru_cache(2)
def tokenizer(path: str) -> Callable[[list[str]], list[bytes]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"].get("dropout"):
        raise ValueError("a tokenizer that drops merges at random gives other ids each time")
    return WordIds(path) if in_words(spec) else WholeIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def packed(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts (one more than blocks) and the blocks' bytes.  The last block is filled up with its last id."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(1, "<u8"), b""
    values = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[-1], ids.dtype)])
    values = values.reshape(n_blocks, BLOCK).astype(np.uint32)
    least = values.min(axis=1)
    rest = values - least[:, None]
    bits_needed = bit_lengths(rest)
    nth_width = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits_needed, nth_width, axis=1)[:, nth_width]
    large = bits_needed > width[:, None]
    n_large = large.sum(axis=1)
    sizes = 6 + BLOCK // 8 * width.astype(np.int64) + 5 * n_large
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((n_blocks, 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_large
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width[width > 0]):
        every = np.flatnonzero(width == w)
        for k in range(0, len(every), AT_ONCE):
            rows = every[k : k + AT_ONCE]
            bits = (rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8)
            body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            out[starts[rows, None] + 6 + np.arange(body.shape[1])] = body
    block, place = np.nonzero(large)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_large) - n_large, n_large)
    tail = starts[block] + 6 + BLOCK // 8 * width[block].astype(np.int64)
    out[tail + nth] = place
    full = values[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail + n_large[block] + 4 * nth)[:, None] + np.arange(4)] = full
    return starts.astype("<u8"), out.tobytes()


def unpacked(starts: np.ndarray, body: bytes, n_ids: int) -> np.ndarray:
    """The ids of all blocks; the inverse of ``packed``."""
    data, n_blocks = np.frombuffer(body, np.uint8), len(starts) - 1
    if not n_blocks:
        return np.zeros(0, "<u4")
    at = starts[:-1].astype(np.int64)
    head = data[at[:, None] + np.arange(6)]
    least = head[:, :4].copy().view("<u4").ravel()
    width, n_large = head[:, 4], head[:, 5].astype(np.int64)
    values = np.repeat(least[:, None], BLOCK, axis=1)
    for w in np.unique(width[width > 0]):
        every, weight = np.flatnonzero(width == w), (1 << np.arange(w, dtype=np.uint32)).astype(np.uint32)
        for k in range(0, len(every), AT_ONCE):
            rows = every[k : k + AT_ONCE]
            bits = np.unpackbits(data[at[rows, None] + 6 + np.arange(BLOCK // 8 * int(w))], axis=1, bitorder="little")
            values[rows] += (bits.reshape(len(rows), BLOCK, int(w)) * weight).sum(axis=2, dtype=np.uint32)
    block = np.repeat(np.arange(n_blocks), n_large)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_large) - n_large, n_large)
    tail = at[block] + 6 + BLOCK // 8 * width[block].astype(np.int64)
    full = data[(tail + n_large[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    values[block, data[tail + nth]] = full
    return values.ravel()[:n_ids].astype("<u4")


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    starts, body = packed(ids)
    parts = [
        MAGIC,
        struct.pack("<3Q", len(lengths), len(ids), len(starts) - 1),
        starts.tobytes(),
        np.array(lengths, "<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        body,
    ]
    whole = b"".join(parts)
    return whole + struct.pack("<I", zlib.crc32(whole))


def file_parts(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file."""
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("not a whole file of packed ids")
    n_docs, n_ids, n_blocks = struct.unpack_from("<3Q", data, 8)
    at = 32
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    at += 8 * (n_blocks + 1)
    lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    keys = np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs).tolist()
    null = np.frombuffer(data, np.uint8, n_docs, at + 16 * n_docs).tolist()
    ids = unpacked(starts, data[at + 17 * n_docs : -4], n_ids)
    return [None if x else k for k, x in zip(keys, null, strict=True)], lengths, ids


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark takes it to have."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(made).toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path there."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


MANIFEST = "part int, nth int, file string, n_docs long, n_ids long"


def written(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS
) -> DataFrame:
    """Encode whole texts, an end id after each, and write them; the stored manifest of files."""
    folder = qualified(docs.sparkSession, shared_path(docs.sparkSession, f"ids-{uuid.uuid4().hex}"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, nth = tokenizer(path), TaskContext.get().partitionId(), 0
        system, base = opened(folder)
        end = np.array([END_ID], "<u4").tobytes()
        keys: list[int | None] = []
        made: list[bytes] = []

        def flush() -> pa.RecordBatch:
            system.create_dir(base, recursive=True)
            name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.pfor"
            ids = np.frombuffer(b"".join(made), "<u4")
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(keys, [len(x) // 4 for x in made], ids))
            row = {"part": part, "nth": nth, "file": f"{folder}/{name}", "n_docs": len(keys), "n_ids": len(ids)}
            types = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
            return pa.RecordBatch.from_pylist([row], types)

        held = 0
        for b in batches:
            encoded = (ids for part in in_parts(b.column("text"), ids_of.at_once) for ids in ids_of(part))
            for key, ids in zip(b.column("doc_id").to_pylist(), encoded, strict=True):
                keys.append(key)
                made.append(ids + end)
                held += len(made[-1]) // 4
                if held >= file_ids:
                    yield flush()
                    keys, made, held, nth = [], [], 0, nth + 1
        if keys:
            yield flush()

    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = plain.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """``file, start`` of every file: the ids in all files before it.

    First over the tasks' totals, then among the files of one task.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all_ids").over(before), F.lit(0)).alias("offset"))
    files = manifest.withColumn("inner", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return files.join(parts, "part").select("file", (F.col("offset") + F.col("inner")).alias("start"))


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; a file is read by one task."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                system, name = opened(file)
                with system.open_input_stream(name) as f:
                    keys, lengths, ids = file_parts(f.read())
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = placed(manifest)
    tasks = max(1, min(manifest.count(), 10_000))
    return files.repartition(tasks).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    return read(written(docs, path, file_ids=file_ids))
