"""BPE encoding and decoding with a word-level tokenizer of the ``tokenizers`` library.

Texts are normalized and split into words beside their scan. Every distinct word of a batch is encoded once and
kept in a bounded table; the ids go back by position. Decoding looks every id's piece up in the id-to-piece table
and joins the pieces. See README for why the word table is not joined through a shuffle.

The tokenizer file must have the normalizer NFC, blanks, lower case, a word-splitting pattern, byte-level symbols
with word ends, and no decoder; anything else raises an error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.tables import extended, released, without

SLICE_CHARS = 1 << 19
TABLE_WORDS = 100_000  # words that a worker remembers

_open: dict[str, WordTable] = {}


@dataclass(frozen=True)
class BpeFile:
    """A tokenizer file's content; sent to the tasks, as executors may not have the file."""

    content: str

    @staticmethod
    def read(path: str) -> BpeFile:
        with open(path, encoding="utf-8") as file:
            out = BpeFile(file.read())
        spec = json.loads(out.content)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a word-level BPE file of the known kind")
        return out


class WordTable:
    """Ids of the words seen so far, as one flat array with offsets."""

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(content)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        # \s is the property White_Space there.
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pieces = spec["model"]["vocab"] | self.special
        self.pieces = pa.array([p for p, _ in sorted(pieces.items(), key=lambda x: x[1])])
        self.tokenizer = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": level, "added_tokens": []}))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, number in self.special.items():
            self._add([token], [[number]])

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.array([i for x in ids for i in x], np.int32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])

    def words(self, text: str) -> list[str]:
        """Normalized words; special tokens in the text stand for themselves, as they are."""
        if "<|" in text and len(parts := self.cut.split(text)) > 1:
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words(part))]
        # Lower case is by character there: no final sigma.
        return self.pattern.findall(normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins."""
        split = [self.words(t) for t in texts]
        if len(self.number) > TABLE_WORDS:
            self.clear()
        new = list({w for words in split for w in words} - self.number.keys())
        if new:
            self._add(new, [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)])
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((n for words in split for n in map(self.number.__getitem__, words)), np.int64, int(sizes.sum()))
        count = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(count)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[at] - ends + count, count)]
        words = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.concatenate([[0], ends])[words]


def _table(file: BpeFile) -> WordTable:
    if file.content not in _open:
        _open.clear()
        _open[file.content] = WordTable(file.content)
    return _open[file.content]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for row, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > SLICE_CHARS:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def _encode(batches: Iterator[pa.RecordBatch], table: WordTable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in _slices(batch.column("text")):
            ids, begins = table.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), lists], names=["doc_id", "ids"])
    # Workers live on: what this task has learned must not stand beside later operators' needs.
    table.clear()


def _decode(batches: Iterator[pa.RecordBatch], pieces: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield part, [pc.binary_join(pa.ListArray.from_arrays(ends, pieces.take(lists.flatten())), " ")]


def encoded(docs: DataFrame, file: BpeFile) -> DataFrame:
    """``doc_id, ids`` of every row; a null text is an empty one and has no ids. Further columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(file)
    run = released(lambda batches: _encode(batches, _table(shared.value)))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, file: BpeFile) -> DataFrame:
    """``encoded``, then ``decoded``: ``doc_id, ids, decoded`` of every row.

    Both work in one Python process of a task. Two operators would hold a process, with a table, each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(shared.value)
        for part, new in _decode(_encode(batches, table), table.pieces):
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(released(run), "doc_id bigint, ids array<int>, decoded string")


def decoded(rows: DataFrame, file: BpeFile) -> DataFrame:
    """``rows`` with ``decoded``: the pieces of ``ids`` (special tokens too), joined by one blank. Null ids are none."""
    shared = rows.sparkSession.sparkContext.broadcast(file)
    rows = without(rows, ["decoded"])
    return extended(rows, ["ids"], lambda batches: _decode(batches, _table(shared.value).pieces), "decoded string")
