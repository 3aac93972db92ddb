"""Suffix arrays by linear grouping, and removal of repeated byte strings with them.

``suffix_array`` groups suffixes by their longest Lyndon prefix, taking groups
in descending order and splitting lower groups by the previous smaller suffixes
of their members, and then emits the groups' suffixes in order. Nothing is
renamed recursively.

``dedup_bytes`` applies it to a corpus. Windows of ``window`` bytes are keyed by
an anchor, the smallest hash among their inner strings, which equal windows
share. The windows of one anchor in a row form a segment. Equal segments settle
each other; the different segments of one anchor go to one bucket, whose suffix
array brings equal windows next to each other.

A string that many unlike texts share, such as a footer, would bring all their
segments to one bucket. Where an anchor has many different segments, in a chunk
or on the whole, its windows are dealt one by one instead, by their own hashes,
so that only equal windows meet.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.fingerprints import ENTRIES, LAST, ROWS, Answer, Batch, bucket_of, exchange, gathered, joined, keyed, mix, own_id, pack_arrays, texts_of, unpack_positions
from sparklog.llm.shared import Scratch, fingerprint_partitions, free_name, measured, pieces, utf8
from sparklog.llm.substrings import runs

CHUNK = 2_000_000
REPEAT, ASKED = 1, 2
#: Different segments of one anchor, in a chunk and in all, beyond which its windows are dealt one by one.
HOT_IN_CHUNK, HOT = 16, 4096
#: Stands for the bucket of windows that are dealt one by one.
DEALT = (1 << 32) - 1
#: What blocks of the second exchange begin with.
TEXTS, WINDOWS = b"T", b"W"

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in lexicographic order; a shorter suffix comes before its extensions."""
    n = len(symbols) + 1  # the empty suffix is the last and the smallest
    text = [*symbols, min(symbols, default=0) - 1]
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            end[start] = i
            start = i
        place[s], group[s] = i, start
    end[start] = n
    smaller = [-1] * n

    # Grouping: what a finished group's members have before them splits the groups that those are in.
    top = n
    while top > 0:
        first = group[order[top - 1]]
        members = order[first:top]
        top = first
        members.sort()
        before: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > first:
                p = smaller[p]
            if p >= 0 and group[p] == first:  # the Lyndon word stands there as well
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                before[p] = before.get(p, 0) + 1
        if not before:
            continue
        by_count: dict[int, list[int]] = defaultdict(list)
        for p, times in before.items():
            by_count[times].append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[times]:
                own = group[p]
                moved.setdefault(own, end[own])
                last = end[own] = end[own] - 1
                other, at = order[last], place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
            for own, old in moved.items():
                new = end[own]
                if new == own:
                    end[own] = old
                else:
                    end[new] = old
                    for p in order[new:old]:
                        group[p] = new

    # Order: a suffix puts those whose next smaller suffix it is behind what their groups have so far.
    out, fill, placed = [0] * n, list(range(n)), bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    fill[0] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            own = group[s]
            out[fill[own]] = s
            fill[own] += 1
            placed[s] = 1
            s = smaller[s]
    return out[1:]


#: Phrases end with white space or a byte that UTF-8 never has, so none is the beginning of another.
_PHRASE = re.compile(rb"[^ \n\t\xff]*[ \n\t\xff]")


def window_order(text: bytes, starts: np.ndarray) -> np.ndarray:
    """The indexes of ``starts`` in the order of the suffixes of ``text`` there.

    The text ends with byte 255. It is parsed into phrases, whose suffix array
    is built; a suffix of the text is what is left of its phrase, and then the
    suffix of phrases behind it.
    """
    phrases = _PHRASE.findall(text)
    names = sorted(set(phrases))
    number = {p: i for i, p in enumerate(names)}
    parse = [number[p] for p in phrases]
    order = np.array(suffix_array(parse), np.int64)
    rank = np.full(len(parse) + 1, -1, np.int64)
    rank[order] = np.arange(len(parse))
    edges = np.concatenate([[0], np.cumsum([len(p) for p in phrases])])
    at = np.searchsorted(edges, starts, side="right") - 1
    offset = starts - edges[at]
    code = np.array(parse, np.int64)[at] << np.int64(32) | offset
    used, inverse = np.unique(code, return_inverse=True)
    rests = [names[c >> 32][c & 0xFFFFFFFF :] for c in used.tolist()]
    ranked = {r: i for i, r in enumerate(sorted(set(rests)))}
    rest = np.array([ranked[r] for r in rests], np.int64)[inverse]
    return np.lexsort((rank[at + 1], rest))


def equal_neighbours(text: np.ndarray, starts: np.ndarray, window: int, step: int = 20_000) -> np.ndarray:
    """For each start but the first, whether its window equals that of the start before."""
    views, out = sliding_window_view(text, window), np.zeros(max(len(starts) - 1, 0), bool)
    for a in range(0, len(out), step):
        rows = views[starts[a : a + step + 1]]
        out[a : a + step] = (rows[1:] == rows[:-1]).all(axis=1)
    return out


def anchors(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, how far its anchor is; and the hash of the string at each place.

    The anchor is the leftmost smallest hash of the strings in the window, found
    by doubling.
    """
    levels = (2 * window // 3).bit_length() - 1
    size = window - (1 << levels) + 1
    if size < 8:
        raise ValueError("windows of 22 bytes or more are needed")
    words = np.ascontiguousarray(np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,)))
    n = len(text) - size + 1
    value = np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, size - 8, 8), size - 8]):
        value += words[at : at + n] * np.uint64(0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82A * i & (1 << 64) - 1 | 1)
        value ^= value >> np.uint64(29)
    hashes = value = mix(value)
    ahead = np.zeros(n, np.uint8 if levels < 8 else np.uint32)
    for level in range(levels):
        step = 1 << level
        right, n = value[step:], len(value) - step
        less = right < value[:n]
        ahead = np.where(less, ahead[step:] + step, ahead[:n]).astype(ahead.dtype)
        value = np.where(less, right, value[:n])
    return ahead, hashes


def others(first: np.ndarray, ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Entries that are neither the first of their run nor the same place in a repeated row."""
    lead = np.repeat(first, np.diff(np.append(first, len(doc))))
    return (ids[doc] != ids[doc[lead]]) | (tags[doc] != tags[doc[lead]]) | (pos != pos[lead])


def send_segments(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Sends each segment's anchor and hash; those that the chunk has before are repeats already."""
    out, digest = Batch(), xxhash.xxh3_64_intdigest
    for _, ids, tags, texts in texts_of(batches, 2, CHUNK):
        sizes = np.array([len(t) for t in texts], np.int64)
        first_byte = np.cumsum(sizes) - sizes
        joined_text = b"".join(texts)
        if len(joined_text) < window:
            continue
        ahead, hashes = anchors(np.frombuffer(joined_text, np.uint8), window)
        doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
        counts = np.maximum(sizes - window + 1, 0)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = first_byte[doc] + pos
        anchor = at + ahead[at]
        first = runs(anchor, doc)
        size = np.diff(np.append(first, len(doc)))
        doc, pos, at, anchor = doc[first], pos[first], at[first], anchor[first]
        key = mix(hashes[anchor] + np.uint64(1))  # anchors have small hashes, buckets need even ones
        content = np.fromiter((digest(joined_text[a : a + n]) for a, n in zip(at.tolist(), (size + window - 1).tolist(), strict=True)), np.uint64, len(at))
        order = np.lexsort((pos, ids[doc], content, key))
        key, content, doc, pos, size = key[order], content[order], doc[order], pos[order], size[order].astype(np.uint16)
        first = runs(key, content)
        again = others(first, ids, tags, doc, pos)
        out.answers(ids, tags, doc[again], pos[again], [size[again]], REPEAT, buckets, through=True)
        anchor = runs(key[first])
        kinds = np.diff(np.append(anchor, len(first)))
        hot = first[np.repeat(kinds > HOT_IN_CHUNK, kinds)]
        out.answers(ids, tags, doc[hot], pos[hot], [size[hot], np.full(len(hot), DEALT, np.uint32)], ASKED, buckets, through=True)
        # Of a hot anchor one entry without windows is sent, which tells the bucket that it is hot.
        size[first[anchor[kinds > HOT_IN_CHUNK]]] = 0
        sent = first[np.repeat(kinds <= HOT_IN_CHUNK, kinds) | (size[first] == 0)]
        out.entries(key[sent], ids, tags, doc[sent], pos[sent], [content[sent], size[sent]], buckets)
        yield out.take(ROWS)


def settle_segments(blocks: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, list[Answer]]:
    """Of equal segments all but the first are repeats; anchors with different segments ask for these, or for their windows."""
    key, ids, tags, doc, pos, content, size = joined(blocks)
    hot = np.unique(key[size == 0])
    real = np.flatnonzero(size > 0)
    order = real[np.lexsort((pos[real], ids[doc[real]], content[real], key[real]))]
    key, content, doc, pos, size = key[order], content[order], doc[order], pos[order].astype(np.int64), size[order]
    first = runs(key, content)
    again = others(first, ids, tags, doc, pos)
    anchor = runs(key[first])
    kinds = np.diff(np.append(anchor, len(first)))
    dealt = np.isin(key[first[anchor]], hot) | (kinds > HOT)
    asked = np.repeat((kinds > 1) | dealt, kinds)
    where = np.where(np.repeat(dealt, kinds), DEALT, bucket_of(key[first], buckets)).astype(np.uint32)
    return ids, tags, [
        (REPEAT, doc[again], pos[again], [size[again]]),
        (ASKED, doc[first[asked]], pos[first[asked]], [size[first[asked]], where[asked]]),
    ]


def window_hashes(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that starts at ``at``."""
    words = np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,))
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        value = np.zeros(len(at), np.uint64)
        for i, offset in enumerate([*range(0, window - 8, 8), window - 8]):
            value += words[at + offset] * np.uint64(seed * (2 * i + 1) & (1 << 64) - 1 | 1)
            value = mix(value ^ np.uint64(seed))
        out.append(value)
    return out[0], out[1]


def stretches(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows as one stretch: its document, start and number of windows."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    begin = np.ones(len(doc), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    begin = np.flatnonzero(begin)
    return doc[begin], pos[begin], np.diff(np.append(begin, len(doc))).astype(np.uint32)


def send_windows(out: Batch, ids: np.ndarray, tags: np.ndarray, texts: list[bytes], doc: np.ndarray, pos: np.ndarray, size: np.ndarray, window: int, buckets: int) -> None:
    """Sends the windows of hot anchors by their hashes; those that the chunk has before are repeats already."""
    body = b"".join(texts)
    base = np.cumsum([0] + [len(t) for t in texts])
    own = np.repeat(np.arange(len(size)), size)
    doc, pos = doc[own], pos[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    key, check = window_hashes(np.frombuffer(body, np.uint8), base[doc] + pos, window)
    order = np.lexsort((pos, ids[doc], check, key))
    key, check, doc, pos = key[order], check[order], doc[order], pos[order]
    first = runs(key, check)
    again = others(first, ids, tags, doc, pos)
    d, p, n = stretches(doc[again], pos[again])
    out.answers(ids, tags, d, p, [n], REPEAT, buckets, through=True)
    out.entries(key[first], ids, tags, doc[first], pos[first], [check[first]], buckets, WINDOWS)


def settle_windows(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[Answer]]:
    """Of equal windows all but the first are repeats."""
    key, ids, tags, doc, pos, check = joined(blocks)
    pos = pos.astype(np.int64)
    order = np.lexsort((pos, ids[doc], check, key))
    doc, pos = doc[order], pos[order]
    again = others(runs(key[order], check[order]), ids, tags, doc, pos)
    d, p, n = stretches(doc[again], pos[again])
    return ids, tags, [(REPEAT, d, p, [n])]


def settle_asked(blocks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, list[Answer]]:
    texts, windows = ([b[1:] for b in blocks if b[:1] == mark] for mark in (TEXTS, WINDOWS))
    if not texts or not windows:
        return settle_texts(texts, window) if texts else settle_windows(windows)
    ids, tags, answers = settle_texts(texts, window)
    more_ids, more_tags, more = settle_windows(windows)
    answers += [(kind, doc + len(ids), pos, rest) for kind, doc, pos, rest in more]
    return np.concatenate([ids, more_ids]), np.concatenate([tags, more_tags]), answers


def send_texts(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Sends the text of the segments that were asked for, or their windows."""
    out = Batch()
    for batch, ids, tags, texts in texts_of(batches, 2, CHUNK):
        docs, starts, sizes, where = [], [], [], []
        for i, block in enumerate(batch.column(3).to_pylist()):
            pos, size, bucket = unpack_positions(block)
            docs.append(np.full(len(pos), i))
            starts.append(pos)
            sizes.append(size)
            where.append(bucket)
        doc, pos, size, bucket = (np.concatenate(x) for x in (docs, starts, sizes, where))
        dealt = bucket == DEALT
        if dealt.any():
            send_windows(out, ids, tags, texts, doc[dealt], pos[dealt], size[dealt].astype(np.int64), window, buckets)
        doc, pos, size, bucket = doc[~dealt], pos[~dealt], size[~dealt], bucket[~dealt]
        order = np.lexsort((pos, doc, bucket))
        doc, pos, size, bucket = doc[order], pos[order], size[order], bucket[order]
        edges = runs(bucket).tolist()
        for a, b in zip(edges, [*edges, len(doc)][1:], strict=True):
            used, index = np.unique(doc[a:b], return_inverse=True)
            head = pack_arrays(np.zeros(b - a, np.uint64), ids[used].view(np.uint64), tags[used].view(np.uint64), index.astype(np.uint32), pos[a:b].astype(np.uint32), size[a:b])
            body = b"".join([texts[d][p : p + n + window - 1] for d, p, n in zip(doc[a:b].tolist(), pos[a:b].tolist(), size[a:b].tolist(), strict=True)])
            out.rows.append((int(bucket[a]), ENTRIES, None, TEXTS + struct.pack("<I", len(head)) + head + zstandard.compress(body, 1)))
        yield out.take(ROWS)


def settle_texts(blocks: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, list[Answer]]:
    """Sorts the windows of a bucket's segments; of equal ones all but the first are repeats."""
    heads, bodies = [], []
    for block in blocks:
        (n,) = struct.unpack_from("<I", block)
        heads.append(block[4 : 4 + n])
        bodies.append(zstandard.decompress(block[4 + n :]))
    _, ids, tags, doc, pos, size = joined(heads)
    pos, size = pos.astype(np.int64), size.astype(np.int64)
    lengths = size + window - 1
    body, at, parts = b"".join(bodies), 0, []
    for n in lengths.tolist():
        parts.append(body[at : at + n])
        at += n
    text = b"\xff".join(parts) + b"\xff"
    base = np.cumsum(lengths + 1) - (lengths + 1)
    own = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    starts, doc, pos = base[own] + inside, doc[own], pos[own] + inside
    order = window_order(text, starts)
    same = equal_neighbours(np.frombuffer(text, np.uint8), starts[order], window)
    run = np.concatenate([[0], np.cumsum(~same)])
    # The first window of each run, by doc_id and place; the others are repeats.
    ranked = np.lexsort((pos[order], ids[doc[order]], run))
    index = order[ranked]
    index = index[others(runs(run[ranked]), ids, tags, doc[index], pos[index])]
    d, p, n = stretches(doc[index], pos[index])
    return ids, tags, [(REPEAT, d, p, [n])]


def covered(n: int, block: bytes, window: int) -> np.ndarray:
    """Which of a text's bytes the windows that start at the given places cover."""
    start, size = unpack_positions(block)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch, ids, _, texts in texts_of(batches, 2, 4 * CHUNK):
        rows = []
        for text, doc, block in zip(texts, ids.tolist(), batch.column(3).to_pylist(), strict=True):
            removed, spans, kept = 0, 0, text
            if block:
                gone = covered(len(text), block, window)
                removed, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())], names=[f.split()[0] for f in RESULT.split(", ")])


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, tag, block): where each document has windows that start earlier too, and how many in a row."""
    base, buckets = keyed(docs), fingerprint_partitions(docs)
    settled = scratch.save(exchange(base, lambda b, n: send_segments(b, n, window), settle_segments, buckets), "segments")
    asked = base.join(gathered(settled, buckets, ASKED).hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "block")
    sorted_ = scratch.save(exchange(asked, lambda b, n: send_texts(b, n, window), lambda b, _: settle_asked(b, window), buckets), "windows")
    repeats = scratch.save(gathered(settled.unionByName(sorted_), buckets, REPEAT), "repeats")
    scratch.drop(settled, sorted_)
    return repeats


def cut_texts(docs: DataFrame, window: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``dedup_bytes`` applied to its texts; columns stay, an ``n_chars`` column follows.

    Where a cut goes through a character, its other bytes go too. A text that is
    repeated as a whole becomes empty, a null text stays null; rows stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    docs = measured(docs, scratch)
    repeats = repeated_windows(docs, window, scratch)
    own, tag, block = (free_name(docs, x) for x in ("own", "tag", "block"))
    known = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(tag, F.xxhash64("text"))
    marked = known.join(repeats.select(F.col("doc_id").alias(own), F.col("tag").alias(tag), F.col("block").alias(block)).hint("shuffle_hash"), [own, tag], "left").select(*docs.columns, block)
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.index("text")
        for batch in pieces(batches, text=at, most=4 * CHUNK):
            columns = list(batch.columns[:-1])
            kept = []
            for text, found, null in zip(utf8(columns[at]), batch.column(len(fields)).to_pylist(), columns[at].is_null().to_pylist(), strict=True):
                if found:
                    text = np.frombuffer(text, np.uint8)[~covered(len(text), found, window)].tobytes().decode("utf-8", "ignore").encode()
                kept.append(None if null else text)
            columns[at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in fields else out


def dedup_bytes(docs: DataFrame, window: int = 100, with_bytes: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Removes bytes covered by a string of ``window`` bytes that also starts earlier.

    Earlier is in a document of smaller doc_id, or in the same document before.
    Texts are taken as UTF-8 and judged on the input; matches stay within a
    document. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 of what is left, and with ``with_bytes`` kept itself,
    which may hold cut characters.

    A null text is empty; texts shorter than a window lose nothing. Of repeated
    rows with one doc_id and text all copies are the same document: none removes
    the other. Rows of one doc_id with different texts count as one document in
    the order of places. A null doc_id comes after all others. Other columns are
    ignored. An empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    docs = measured(docs.select("doc_id", "text"), scratch)
    base = keyed(docs)
    repeats = repeated_windows(docs, window, scratch)
    marked = base.join(repeats.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "block")
    out = marked.mapInArrow(lambda b: remove(b, window, with_bytes), RESULT).withColumn("doc_id", own_id())
    return out if with_bytes else out.drop("kept")
