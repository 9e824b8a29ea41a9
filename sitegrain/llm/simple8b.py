"""Token ids in word-aligned files (Simple-8b).

A 64-bit word holds a selector in its top four bits and up to 60 bits of ids: a selector says how many ids follow
and how wide each is. Ids of more than 60 bits follow an escape word as they are. Ids are packed in blocks of
``BLOCK`` that are independent of each other; offsets tell where each block's words begin, so all blocks of a
chunk are packed and unpacked at once.

A file set is a Parquet folder. A row is a chunk: some documents in ascending order of doc_id, with their id counts,
block offsets (unsigned 32-bit) and words (unsigned 64-bit), both little-endian. Spark writes and commits the files,
so a lost task leaves nothing half written.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 128
CHUNK_CHARS = 1 << 20
FILE_CHARS = 1 << 24
ESCAPE = 0
# Count and width by selector. Selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
_ORDER = [15, *range(1, 15)]  # most ids first


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block offsets (in words, with the end) and words of unsigned ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    width = np.frexp(grid.astype(np.float64))[1].astype(np.uint8).reshape(blocks, BLOCK)
    wide = np.zeros((blocks, 2 * BLOCK), np.uint8)  # blanks behind each block fit anywhere
    wide[:, :BLOCK] = width
    spans = {1: wide}
    for k in (1, 2, 4, 8, 16, 32):
        spans[2 * k] = np.maximum(spans[k], np.pad(spans[k][:, k:], ((0, 0), (0, k))))
    choice = np.zeros((blocks, BLOCK), np.int8)
    open_ = np.ones((blocks, BLOCK), bool)
    for s in _ORDER:
        count = int(COUNTS[s])
        half = 1 << (count.bit_length() - 1)
        top = np.maximum(spans[half][:, :BLOCK], spans[half][:, count - half : count - half + BLOCK])
        fits = open_ & (top <= WIDTHS[s])
        choice[fits] = s
        open_ &= ~fits
    rows = np.zeros((blocks, BLOCK * 2), np.uint64)
    grid = np.pad(grid.reshape(blocks, BLOCK), ((0, 0), (0, BLOCK)))
    at, used, live = np.zeros(blocks, int), np.zeros(blocks, int), np.arange(blocks)
    while len(live):
        chosen = choice[live, at[live]]
        for s in np.unique(chosen):
            own = live[chosen == s]
            if s == ESCAPE:
                rows[own, used[own] + 1] = grid[own, at[own]]
                used[own] += 2
                at[own] += 1
                continue
            count, bits = int(COUNTS[s]), int(WIDTHS[s])
            word = np.full(len(own), np.uint64(s) << np.uint64(60))
            if bits:
                values = grid[own[:, None], at[own][:, None] + np.arange(count)]
                word |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
            rows[own, used[own]] = word
            used[own] += 1
            at[own] += count
        live = live[at[live] < size[live]]
    offsets = np.concatenate([[0], np.cumsum(used)])
    return offsets.astype(np.uint32), rows[np.arange(rows.shape[1]) < used[:, None]]


def unpack(n: int, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ``n`` ids of :func:`pack`."""
    out = np.zeros(-(-n // BLOCK) * BLOCK, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    # A word behind an escape is an id, whatever its top bits; escapes are rare.
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    count = np.where(raw, 0, COUNTS[selector])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    before = np.cumsum(count) - count
    begin = before - before[offsets[:-1].astype(np.int64)][block]
    for s in range(16):
        own = np.flatnonzero((selector == s) & ~raw)
        if not len(own) or s == 15:
            continue
        if s == ESCAPE:
            out[block[own] * BLOCK + begin[own]] = words[own + 1]
            continue
        bits = np.uint64(WIDTHS[s])
        place = begin[own][:, None] + np.arange(COUNTS[s])
        value = (words[own][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * bits)) & ((np.uint64(1) << bits) - np.uint64(1))
        inside = place < BLOCK
        out[(block[own][:, None] * BLOCK + place)[inside]] = value[inside]
    return out[:n]


def byte_encoding(content: str):
    """The byte-level tokenizer of a ``tokenizers`` file, as an encoder that turns whole texts into arrays."""
    import tiktoken

    spec = json.loads(content)
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


LONG_RUN = 1 << 12
_RUNS = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


class Encoder:
    """Ids of whole texts, as the ``tokenizers`` library gives them.

    ``byte_encoding`` takes a run of blanks or of other characters as it comes, with a stack and a time that grow with
    the run. Texts with a run of ``LONG_RUN`` characters, which are rare, go through the library itself.
    """

    def __init__(self, content: str) -> None:
        self.content, self.fast, self.library = content, byte_encoding(content), None
        self.special = set(self.fast.special_tokens_set)

    @staticmethod
    def _long_run(text: str) -> bool:
        if len(text) < LONG_RUN:
            return False
        sizes = list(map(len, text.split()))
        # Blanks beyond one between words: without as many as a run has, none is looked for.
        return (max(sizes, default=0) >= LONG_RUN or len(text) - sum(sizes) - len(sizes) >= LONG_RUN - 2) and bool(_RUNS.search(text))

    def encode(self, text: str) -> np.ndarray:
        if not self._long_run(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_CHUNK = "task int, chunk int, doc_ids array<bigint>, counts array<bigint>, n_ids bigint, offsets binary, words binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0, files: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the files, documents in ascending order of doc_id (null first, ties by text).

    ``tokenizer`` is the path of a byte-level ``tokenizers`` file; ``end`` is appended to every document.
    A null text is an empty one. ``files`` defaults to one for every ``FILE_CHARS`` characters of text.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        task, chunk, ids, names, size = TaskContext.get().partitionId(), 0, [], [], 0
        tail = np.array([end], np.uint32)

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            offsets, words = pack(flat)
            counts = [len(x) + len(y) for x, y in zip(ids[::2], ids[1::2])]
            values = [task, chunk, names, counts, len(flat), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids += [encoder.encode(text), tail]
                names.append(name)
                size += len(text)
                if size > CHUNK_CHARS:
                    yield row()
                    chunk, ids, names, size = chunk + 1, [], [], 0
        if names:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    if files is None:
        files = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // FILE_CHARS
    rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _CHUNK).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a file set.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit integers.
    """
    rows = spark.read.schema(_CHUNK).parquet(path)
    first = F.min(F.element_at("doc_ids", 1))
    parts = rows.groupBy("task").agg(F.sum("n_ids").alias("ids"), first.alias("first"))
    # One row per file goes through this window.
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("task", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.select("task", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("offset")).join(parts, "task")
    places = places.select("task", "chunk", (F.col("base") + F.col("offset")).alias("base"))
    # A few numbers per chunk of a million characters find their way back to the chunks.
    table = rows.join(places, ["task", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc_ids, counts, n, base = (batch.column(c)[r].as_py() for c in ("doc_ids", "counts", "n_ids", "base"))
                offsets, words = (np.frombuffer(batch.column(c)[r].as_py(), kind) for c, kind in (("offsets", "<u4"), ("words", "<u8")))
                ids = unpack(n, offsets, words).astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base + begins), pa.array(counts, pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return table.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
