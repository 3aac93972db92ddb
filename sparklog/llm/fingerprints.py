"""Exchanging fingerprints of text positions, and bringing answers back to texts.

A document's position is (doc_id, tag, pos); the tag is a hash of the text, so
that rows that share a doc_id by mistake stay apart. Each chunk of texts sorts
its fingerprints and sends every bucket of the fingerprint range one compressed
block. What can be settled inside a chunk is settled there, so a fingerprint
that a third of all rows share is sent once per chunk, not once per row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import pieces, utf8

#: Stands for a null doc_id, which so comes after all others.
LAST = (1 << 63) - 1

#: What chunks send: entries for a bucket (kind -1), or answers for a group of documents that pass through.
ROWS = "bucket int, kind int, group int, block binary"
ANSWERS = "kind int, group int, block binary"
POSITIONS = "doc_id long, tag long, block binary"
ENTRIES = -1

_UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null as ``LAST``), tag and text of each row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text").alias("text"))


def own_id(doc_id: str = "doc_id") -> Column:
    return F.nullif(F.col(doc_id), F.lit(LAST)).alias(doc_id)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` numbers in a row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc, base = h[:n].copy(), np.uint64(base)
    for j in range(1, width):
        acc *= base
        acc += h[j : n + j]
    return mix(acc)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, byte planes apart, compressed."""
    parts = [struct.pack("<B", len(arrays))]
    parts += [struct.pack("<BQ", a.itemsize, len(a)) for a in arrays]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join(parts), 1)


def unpack_arrays(block: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    heads = [struct.unpack_from("<BQ", raw, 1 + 9 * i) for i in range(raw[0])]
    at, out = 1 + 9 * len(heads), []
    for size, n in heads:
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(_UNSIGNED[size]).ravel())
        at += n * size
    return out


def unpack_positions(block: bytes | None) -> list[np.ndarray]:
    """A document's positions, and what goes with each."""
    if block is None:
        return []
    first, *more = unpack_arrays(block)
    return [np.cumsum(first, dtype=np.int64), *more]


class Batch:
    """Rows to be given back to Spark."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def entries(self, key: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray, more: list[np.ndarray], buckets: int, mark: bytes = b"") -> None:
        """Sends entries, sorted by key; doc indexes ids and tags. ``mark`` precedes their blocks."""
        bucket = bucket_of(key, buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        for a, b in zip(edges, edges[1:] + [len(key)], strict=True):
            used, index = np.unique(doc[a:b], return_inverse=True)
            kind = np.uint16 if len(used) < 1 << 16 else np.uint32
            block = pack_arrays(np.diff(key[a:b], prepend=np.uint64(0)), ids[used].view(np.uint64), tags[used].view(np.uint64), index.astype(kind), pos[a:b].astype(np.uint32), *[m[a:b] for m in more])
            self.rows.append((int(bucket[a]), ENTRIES, None, mark + block))

    def answers(self, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray, more: list[np.ndarray] = [], kind: int = 0, groups: int = 1, through: bool = False) -> None:  # noqa: B006
        """Gives documents positions of theirs, one row per group of documents; ``through`` an exchange or not."""
        if not len(doc):
            return
        group = (mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(np.int64)[doc]
        order = np.lexsort((pos, doc, group))
        group, doc, pos, more = group[order], doc[order], pos[order], [m[order] for m in more]
        edges = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
        for a, b in zip(edges, edges[1:] + [len(doc)], strict=True):
            used, index = np.unique(doc[a:b], return_inverse=True)
            block = pack_arrays(ids[used].view(np.uint64), tags[used].view(np.uint64), np.diff(index, prepend=0).astype(np.uint32), pos[a:b].astype(np.uint32), *[m[a:b] for m in more])
            row = (kind, int(group[a]), block)
            self.rows.append((int(group[a]), *row) if through else row)

    def take(self, schema: str) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def texts_of(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    """Chunks of rows as (batch, ids, tags, texts)."""
    for batch in pieces(batches, text=text, most=most):
        yield batch, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), utf8(batch.column(text))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets divide the range of keys evenly."""
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


#: (kind, doc, pos, more): documents, by index, that are to be given positions.
Answer = tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]


def exchange(source: DataFrame, send: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]], settle: Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray, list[Answer]]], buckets: int) -> DataFrame:
    """Sends blocks of entries to buckets and settles each partition by itself; returns ``ANSWERS``.

    ``settle`` gets the blocks and the number of buckets, and returns ids, tags
    and the answers to their positions.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, out = [], Batch()
        for batch in batches:
            for _, kind, group, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == ENTRIES:
                    blocks.append(block)
                else:
                    out.rows.append((kind, group, block))
            if out.rows:
                yield out.take(ANSWERS)
        if blocks:
            ids, tags, answers = settle(blocks, buckets)
            for kind, doc, pos, more in answers:
                out.answers(ids, tags, doc, pos, more, kind, buckets)
            yield out.take(ANSWERS)

    sent = source.mapInArrow(lambda batches: send(batches, buckets), ROWS)
    return sent.repartitionById(buckets, "bucket").mapInArrow(reduce, ANSWERS)


def chosen(choose: Callable[..., np.ndarray]) -> Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray, list[Answer]]]:
    """Settles by a function of (key, ids, tags, doc, pos, *more) that returns the entries to be answered."""

    def settle(blocks: list[bytes], _: int) -> tuple[np.ndarray, np.ndarray, list[Answer]]:
        key, ids, tags, doc, pos, *more = joined(blocks)
        index = choose(key, ids, tags, doc, pos, *more)
        return ids, tags, [(0, doc[index], pos[index].astype(np.int64), [])]

    return settle


def joined(blocks: list[bytes]) -> list[np.ndarray]:
    """Entries of several blocks as (key, ids, tags, doc, pos, *more); doc indexes ids and tags, which are distinct and sorted."""
    parts = [unpack_arrays(b) for b in blocks]
    key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    base = np.cumsum([0] + [len(p[1]) for p in parts])
    ids, tags, place = distinct(np.concatenate([p[1] for p in parts]).view(np.int64), np.concatenate([p[2] for p in parts]).view(np.int64))
    doc = place[np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parts, base.tolist(), strict=False)])]
    rest = [np.concatenate([p[i] for p in parts]) for i in range(4, len(parts[0]))]
    return [key, ids, tags, doc, *rest]


def distinct(ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and where each given pair is among them."""
    order = np.lexsort((tags, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]) | (tags[order[1:]] != tags[order[:-1]])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return ids[order[new]], tags[order[new]], place


def gathered(answers: DataFrame, buckets: int, kind: int = 0) -> DataFrame:
    """All positions of one kind, one row per document: ``POSITIONS``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_arrays(b) for batch in batches for b in batch.column(0).to_pylist()]
        if not parts:
            return
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        ids, tags, place = distinct(np.concatenate([p[0] for p in parts]).view(np.int64), np.concatenate([p[1] for p in parts]).view(np.int64))
        doc = place[np.concatenate([np.cumsum(p[2], dtype=np.int64) + b for p, b in zip(parts, base.tolist(), strict=False)])]
        rest = [np.concatenate([p[i] for p in parts]) for i in range(3, len(parts[0]))]
        del parts
        order = np.lexsort((rest[0], doc))
        doc, rest = doc[order], [r[order] for r in rest]
        edges = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
        out = Batch()
        for a, b in zip(edges, edges[1:] + [len(doc)], strict=True):
            pos, *more = (r[a:b] for r in rest)
            out.rows.append((int(ids[doc[a]]), int(tags[doc[a]]), pack_arrays(np.diff(pos, prepend=np.uint32(0)), *more)))
        yield out.take(POSITIONS)

    return answers.where(F.col("kind") == kind).select("block", "group").repartitionById(buckets, "group").mapInArrow(merge, POSITIONS)
