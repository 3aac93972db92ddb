"""Removing repeated word sequences: fixed-block anchors.

Of every document, non-overlapping blocks of ``BLOCK`` words are the reference
index. A window of 2 * BLOCK - 1 words or more holds a whole block wherever it
starts, so every window that a later document repeats is found by probing the
index with each rolling run of ``BLOCK`` words. Hits mark the windows around
them, in the probing and in the reference document; these windows are compared
as wholes, each with the smallest doc_id that has it, and runs of repeated
windows are the maximal exact repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.fingerprints import ROWS, Batch, chosen, exchange, gathered, keyed, own_id, rolling, texts_of, unpack_positions
from sparklog.llm.shared import Scratch, fingerprint_partitions, measured, stored_bytes

#: Bytes of text whose repeats are settled before anything is sent.
CHUNK = 8_000_000

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and the number of words of each text."""
    digest, parts = xxhash.xxh3_64_intdigest, []
    for text in texts:
        words = text.split()
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array([len(p) for p in parts], np.int64)


def starts_of(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of ``width`` start that stay in their text: (place in the row of all words, text, place in it)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    n = len(doc) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return at, doc[at], at - first[doc[at]]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal entries of sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def key_bits(stored: int) -> int:
    """Bits of the keys that choose candidates: at most one probe in some thousand of a table of ``stored`` bytes hits by chance.

    A wrong hit costs the comparison of its windows, no result.
    """
    return min(63, max(32, stored.bit_length() + 8))


def probe(batches: Iterator[pa.RecordBatch], buckets: int, block: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Sends each rolling run of ``block`` words; what comes twice in the chunk is a hit already.

    Of equal runs one is sent, an indexed one if there is any, so that an
    entry's place tells whether it is in the index.
    """
    out, high = Batch(), np.uint64((1 << 64) - (1 << 64 - bits))
    for _, ids, tags, texts in texts_of(batches, 2, CHUNK):
        h, counts = word_hashes(texts)
        at, doc, pos = starts_of(counts, block)
        key = rolling(h, block, 0x9E3779B97F4A7C15)[at] & high
        order = np.argsort(key | (pos % block > 0))
        key, doc, pos = key[order], doc[order], pos[order]
        first = runs(key)
        if len(first):
            size = np.diff(np.append(first, len(key)))
            again = np.repeat(size > 1, size)
            out.answers(ids, tags, doc[again], pos[again], groups=buckets, through=True)
            out.entries(key[first], ids, tags, doc[first], pos[first], [], buckets)
        yield out.take(ROWS)


def hit(block: int) -> Callable[..., np.ndarray]:
    """Entries of runs that come more than once, once at least as an indexed block."""

    def choose(key: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        first = runs(key[order])
        size = np.diff(np.append(first, len(order)))
        good = (size > 1) & np.logical_or.reduceat(pos[order] % block == 0, first)
        return order[np.repeat(good, size)]

    return choose


def compare(batches: Iterator[pa.RecordBatch], buckets: int, block: int, window: int) -> Iterator[pa.RecordBatch]:
    """Sends the windows around hits; those with a smaller doc_id in the chunk are repeats already."""
    out = Batch()
    for batch, ids, tags, texts in texts_of(batches, 2, CHUNK):
        h, counts = word_hashes(texts)
        first_word = np.cumsum(counts) - counts
        hits = np.zeros(len(h) + 1, np.int64)
        for start, block_ in zip(first_word.tolist(), batch.column(3).to_pylist(), strict=True):
            hits[start + unpack_positions(block_)[0]] = 1
        seen = np.concatenate([[0], np.cumsum(hits[:-1])])
        at, doc, pos = starts_of(counts, window)
        near = seen[at + window - block + 1] > seen[at]
        at, doc, pos = at[near], doc[near], pos[near]
        key, check = rolling(h, window, 0xC2B2AE3D27D4EB4F)[at], rolling(h, window, 0x165667B19E3779F9)[at]
        order = np.lexsort((ids[doc], check, key))
        key, check, doc, pos = key[order], check[order], doc[order], pos[order]
        first = runs(key, check)
        least = np.repeat(ids[doc[first]], np.diff(np.append(first, len(key))))
        later = ids[doc] > least
        out.answers(ids, tags, doc[later], pos[later], groups=buckets, through=True)
        keep = ~later
        out.entries(key[keep], ids, tags, doc[keep], pos[keep], [(check[keep] >> np.uint64(32)).astype(np.uint32)], buckets)
        yield out.take(ROWS)


def later(key: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Entries of windows that a smaller doc_id has too."""
    order = np.lexsort((ids[doc], check, key))
    first = runs(key[order], check[order])
    least = np.repeat(ids[doc[order[first]]], np.diff(np.append(first, len(order))))
    return order[ids[doc[order]] > least]


def remove(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch, ids, _, texts in texts_of(batches, 2, CHUNK):
        rows = []
        for text, doc, block in zip(texts, ids.tolist(), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            if block:
                edge = np.zeros(len(words) + 1, np.int64)
                (starts,) = unpack_positions(block)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed = int(gone.sum())
            else:
                removed, spans, kept = 0, 0, b" ".join(words)
            rows.append((doc, len(words), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary()).cast(pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])


def dedup_substrings(docs: DataFrame, window: int = 13, block: int | None = None, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Removes words covered by a window that also starts in a document of smaller doc_id.

    Words are runs of anything but ASCII white space, unchanged; windows are
    judged on the input. Returns doc_id, n_words, n_removed, n_spans (maximal
    removed runs) and kept_sha256 of the kept words joined by a space; with
    ``with_text`` also kept_text.

    A null or empty text has no words; one shorter than a window loses none.
    Rows with one doc_id never remove each other's words, be they repeats or
    not. A null doc_id comes after all others. Other columns are ignored. An
    empty table gives no rows.
    """
    block = block or (window + 1) // 2
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts: 2 * block - 1 <= window")
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    docs = measured(docs.select("doc_id", "text"), scratch)
    base, buckets = keyed(docs), fingerprint_partitions(docs)
    bits = key_bits(stored_bytes(docs))
    hits = scratch.save(exchange(base, lambda b, n: probe(b, n, block, bits), chosen(hit(block)), buckets), "hits")
    around = base.join(gathered(hits, buckets).hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "block")
    repeats = scratch.save(exchange(around, lambda b, n: compare(b, n, block, window), chosen(later), buckets), "repeats")
    scratch.drop(hits)
    marked = base.join(gathered(repeats, buckets).hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "block")
    out = marked.mapInArrow(lambda b: remove(b, window, with_text), RESULT).withColumn("doc_id", own_id())
    return out if with_text else out.drop("kept_text")
