"""Repeated substrings: suffix arrays by linear grouping, and fixed-block anchors."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparklog.llm import substrings, suffixes
from sparklog.llm.fingerprints import pack_arrays, unpack_arrays
from tests.llm.conftest import words

LAST = 1 << 63


def cut_bytes(rows, window):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - window + 1):
            first.setdefault(t[p : p + window], (i, p))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] != (i, p):
                gone[p : p + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a), hashlib.sha256(kept).hexdigest()))
    return out


def cut_words(rows, window):
    first = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, LAST), i)
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffixes.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[], [5], [1] * 400, [1, 2] * 200, list(range(300)), list(range(300, 0, -1)), [2, 1, 2, 1, 3] * 60])
def test_suffix_array_of_patterns(symbols):
    assert suffixes.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", min_size=1, max_size=80))
def test_window_order(text):
    raw = text.encode() + b"\xff"
    starts = np.arange(len(raw))
    assert suffixes.window_order(raw, starts).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_anchors_agree_in_equal_windows():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[1500:1800] = text[200:500]
    ahead, _ = suffixes.anchors(text, 100)
    assert (ahead[200:401] == ahead[1500:1701]).all()


@pytest.mark.parametrize("window", [100, 40])
def test_bytes_against_brute_force(docs, window):
    rows = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").distinct().collect()]
    got = suffixes.dedup_bytes(docs, window).distinct().collect()
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(cut_bytes(rows, window))


def test_hot_anchors_against_brute_force(docs, monkeypatch):
    """With a low bound, and so with all anchors that have two segments in a chunk, or in all, dealt by windows."""
    rows = [(LAST - 1 if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").distinct().collect()]
    blocks = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in part], pa.int64()), "tag": pa.array([0] * len(part), pa.int64()), "text": pa.array([t.decode() for _, t in part])}) for part in (rows[::2], rows[1::2])]
    want = {(i, t): cut for i, t, cut in marked_bytes(rows, 100)}
    for in_chunk, in_all in ((16, 4096), (1, 4096), (16, 1)):
        monkeypatch.setattr(suffixes, "HOT_IN_CHUNK", in_chunk)
        monkeypatch.setattr(suffixes, "HOT", in_all)
        assert run_in_process(blocks, rows) == want


def test_a_line_in_unlike_texts_fills_no_bucket():
    """A line of 67 bytes in 20,000 unlike texts: nothing repeats at 100 bytes, and no bucket is larger than others."""
    rng, line = np.random.default_rng(5), b"All texts of this collection end with this line of 67 bytes, this. "
    assert len(line) == 67
    texts = [(rng.integers(97, 123, 70).astype(np.uint8).tobytes() + line + rng.integers(97, 123, 70).astype(np.uint8).tobytes()).decode() for _ in range(20_000)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(a, a + 5000), pa.int64()), "tag": pa.array([0] * 5000, pa.int64()), "text": pa.array(texts[a : a + 5000])}) for a in range(0, 20_000, 5000)]
    buckets = 16
    answers, sent = settled(suffixes.send_segments(iter(batches), buckets, 100), buckets, lambda b: suffixes.settle_segments(b, buckets))
    asked = asked_of(answers)
    again = [with_asked(b, asked) for b in batches]
    more, texts_sent = settled(suffixes.send_texts(iter(again), buckets, 100), buckets, lambda b: suffixes.settle_asked(b, 100))
    for sizes in (sent, texts_sent):
        assert max(sizes) <= 2 * np.median(sizes)
    assert not [a for a in answers + more if a[0] == suffixes.REPEAT]


def settled(batches, buckets, settle):
    """What buckets answer: (kind, doc_id, pos, more), and the bytes that each was sent."""
    answers, blocks, out = [], {}, suffixes.Batch()
    for batch in batches:
        for bucket, kind, group, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == suffixes.ENTRIES:
                blocks.setdefault(bucket, []).append(block)
            else:
                out.rows.append((kind, group, block))
    for own in blocks.values():
        ids, tags, found = settle(own)
        for kind, doc, pos, more in found:
            out.answers(ids, tags, doc, pos, more, kind, buckets)
    for kind, _, block in out.rows:
        ids, _, index, pos, *more = unpack_arrays(block)
        doc = ids.view(np.int64)[np.cumsum(index, dtype=np.int64)]
        answers += [(kind, int(d), int(p), *(int(m[i]) for m in more)) for i, (d, p) in enumerate(zip(doc, pos, strict=True))]
    return answers, [sum(map(len, blocks.get(b, []))) for b in range(buckets)]


def asked_of(answers):
    out = {}
    for kind, doc, *rest in answers:
        if kind == suffixes.ASKED:
            out.setdefault(doc, []).append(rest)
    return out


def with_asked(batch, asked):
    keep = [i for i, d in enumerate(batch.column(0).to_pylist()) if d in asked]
    blocks = []
    for i in keep:
        pos, size, bucket = np.array(sorted(asked[batch.column(0)[i].as_py()])).T
        blocks.append(pack_arrays(np.diff(pos, prepend=0).astype(np.uint32), size.astype(np.uint16), bucket.astype(np.uint32)))
    return pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(blocks, pa.binary())], names=["doc_id", "tag", "text", "block"])


def run_in_process(batches, rows, buckets=3):
    """The operator's steps without Spark: which bytes of each text go."""
    first, _ = settled(suffixes.send_segments(iter(batches), buckets, 100), buckets, lambda b: suffixes.settle_segments(b, buckets))
    asked = asked_of(first)
    more, _ = settled(suffixes.send_texts((with_asked(b, asked) for b in batches), buckets, 100), buckets, lambda b: suffixes.settle_asked(b, 100))
    out = {}
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for kind, doc, pos, size, *_ in first + more:
            if kind == suffixes.REPEAT and doc == i:
                gone[pos : pos + size + 99] = True
        out[i, text] = gone.tolist()
    return out


def marked_bytes(rows, window):
    """(doc_id, text, which of its bytes go), by looking at all windows in order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        gone = [False] * len(text)
        for a in range(len(text) - window + 1):
            w = text[a : a + window]
            if w in seen:
                gone[a : a + window] = [True] * window
            seen.add(w)
        out.append((i, text, gone))
    return out


def test_repeated_rows_are_one_document(spark):
    text = "the quick brown fox jumps over the lazy dog and then it sleeps for a while before it jumps over again, as foxes do"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffixes.dedup_bytes(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]


def test_small_chunks_give_the_same(docs, monkeypatch):
    before = sorted(map(str, suffixes.dedup_bytes(docs).collect()))
    assert sorted(map(str, suffixes.dedup_bytes(docs.repartition(7)).collect())) == before


def test_texts_are_rewritten_in_place(docs):
    out = suffixes.cut_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[12].text == "" and got[12].n_chars == 0 and got[1].text and got[12].blocks == 12
    null = next(r for r in docs.collect() if r.text is None).doc_id
    assert got[null].text is None and got[null].n_chars is None


@pytest.mark.parametrize("window", [13, 5])
def test_words_against_brute_force(docs, window):
    rows = [(LAST if r.doc_id is None else r.doc_id, words(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = substrings.dedup_substrings(docs, window).collect()
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(cut_words(rows, window))


def test_kept_text_matches_its_hash(docs):
    for r in substrings.dedup_substrings(docs, with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_blocks_have_to_fit():
    with pytest.raises(ValueError):
        substrings.dedup_substrings(None, window=10, block=7)


def test_empty_tables(none):
    assert suffixes.dedup_bytes(none).collect() == []
    assert suffixes.cut_texts(none).collect() == []
    assert substrings.dedup_substrings(none).collect() == []
