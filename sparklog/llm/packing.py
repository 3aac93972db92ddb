"""Packing documents into sequences of fixed length: concatenate and cut.

Two passes. The first tokenizes, keeps each document's ids, and numbers the
tokens inside its partition. The partitions' totals then give each partition's
place in the corpus as a prefix sum, so that the second pass knows every
document's global offset and cuts it at the window borders without a shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import Scratch, pieces, utf8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Entries that each of a worker's two word caches holds at most; later words are encoded anew.
CACHE_ENTRIES = 400_000

_PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers give each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# The settings of tokenizers that encode words one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of texts, by way of a cache of words where the tokenizer's settings allow it.

    Tokenizers with the settings above drop white space and never join what it
    separates, so a text's ids are its words' ids in order. A word of letters
    with signs behind it is two pre-tokens; other words go to the tokenizer as
    they are. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_word = (settings.get("normalizer"), settings.get("pre_tokenizer"), settings.get("post_processor")) == (WORD_NORMALIZER, WORD_PRE_TOKENIZER, None)
        self.letters = byte_letters()
        self.cores: dict[bytes, bytes] = {}
        encoder = self

        class Words(dict):
            def __missing__(self, word: bytes) -> bytes:
                ids = encoder.word(word)
                if len(self) < CACHE_ENTRIES:
                    self[word] = ids
                return ids

        self.words = Words()

    def word(self, word: bytes) -> bytes:
        if not (m := _PLAIN.fullmatch(word)):
            return self.whole(word)
        core, tail = m[1].lower(), m[2]
        ids = self.cores.get(core)
        if ids is None:
            ids = self.core(core)
            if ids is not None and len(self.cores) < CACHE_ENTRIES:
                self.cores[core] = ids
        if ids is None:
            return self.whole(word)
        return ids + self.core(tail) if tail else ids

    def core(self, core: bytes) -> bytes | None:
        """Ids of one pre-token; None if it isn't known to be one."""
        if core.isascii():
            text = core.decode()
        else:
            text = unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower()
            if not text.isalpha() or max(text) >= "ɐ":
                return None
            text = "".join([self.letters[b] for b in text.encode()])
        return np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()

    def whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self.whole(text)
        words = self.words
        return b"".join([words[w] for w in text.split()])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of ``length`` tokens.

    Each document is its ids and then ``end_id``; documents follow each other
    without gaps, and window k holds the tokens k * length to (k + 1) * length
    of that stream. Only the last sequence is shorter. One row per document and
    window: doc_id, start (its document's ids before it), length, ids_crc32 (of
    the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id,
    offset.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they come. Long texts span windows. Other columns are ignored. An empty
    table gives no rows. The driver holds one total per partition of the scan.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in pieces(batches):
            ids = [encode(x) + end for x in utf8(batch.column(1))]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            before = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(before), pa.array(counts), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n", "ids"])

    kept = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, "doc_id long, part long, before long, n long, ids binary"), "ids")
    totals = sorted((r[0], r[1]) for r in kept.groupBy("part").agg(F.sum("n")).collect())
    parts = [p for p, _ in totals]
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals], dtype=np.int64)])
    # One row per partition of the scan.
    places = spark.createDataFrame(list(zip(parts, starts.tolist(), strict=False)), "part long, first long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text=4):
            rows: list[tuple] = []
            for doc, first, n, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view, start = memoryview(ids), 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    take = min(n - start, length - offset)
                    rows.append((doc, start, take, zlib.crc32(view[4 * start : 4 * (start + take)]), n, sequence, offset))
                    start += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = kept.join(F.broadcast(places), "part").select("doc_id", (F.col("first") + F.col("before")).alias("first"), "n", "part", "ids")
    return placed.mapInArrow(cut, PIECES)
