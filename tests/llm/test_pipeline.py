"""The corpus pipeline as a whole, and op3 and op4 on given tables."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklog.llm import mixing, neardup, packing, quality, suffixes
from sparklog.llm import queries as Q
from sparklog.llm.shared import read_table
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_neardup import brute
from tests.llm.test_packing_mixing import tokenizer_path
from tests.llm.test_repeats import cut_bytes, marked_bytes

SF = "/root/testdata/sf0.001"
given_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def run(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def by_hand(rows, tokenizer):
    """The stages one after the other, each by its brute-force form; the documents that are mixed."""
    kept = []
    for i, text, source in rows:
        *_, good, cleaned = quality.judge((text or "").encode())
        if good:
            kept.append((i, cleaned.decode(), source))
    found = {}
    for (i, _, label), row in zip(brute([(i, t) for i, t, _ in kept], 5, 80), kept, strict=True):
        if label is None or label == i:
            found.setdefault(len(found), row)
    last = (1 << 63) - 1
    left = list(found.values())
    cut = {}
    for i, text, gone in marked_bytes(sorted({(last if i is None else i, t.encode()) for i, t, _ in left}), 100):
        cut[i, text] = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode("utf-8", "ignore")
    return [(i, cut[last if i is None else i, t.encode()], s) for i, t, s in left]


def test_stages_by_hand(spark, tmp_path):
    """Bad lines, copies, near copies, passages, repeated and null rows go through all stages."""
    base = [prose(i, 150) for i in range(40)]
    passage = prose(500, 70)
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "a") for i in range(4)]
    rows += [(200 + i, base[10 + i].replace("kan", "zzz", 1), "b") for i in range(4)]
    rows += [(300 + i, prose(600 + i, 90) + "\n" + passage + "\n" + prose(700 + i, 90), "c") for i in range(4)]
    rows += [(400, "$$$ %%% &&& ###\n" * 3 + base[20], "c"), (401, None, "a"), (402, "", "a"), (403, "too short", None), (404, prose(800, 120), None), (405, prose(801, 3000), "a")]
    rows += [(5, base[5], "c"), (5, base[5], "c"), (None, prose(802, 120), "b")]
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2, 3, 4, 5, 6, 7) for i, t, s in rows]
    got = run(spark, spark.createDataFrame(full, SCHEMA).repartition(3), tmp_path)
    want = by_hand(rows, None)
    docs = spark.createDataFrame([(i, t, s) for i, t, s in want], "doc_id long, text string, source string")
    copies = {}
    encoder = packing.WordEncoder(tokenizer_path())
    for r in mixing.mixed(docs).collect():
        crc = encoder.encode(r.text.encode()) + (2).to_bytes(4, "little")
        copies.setdefault((r.doc_id, len(crc) // 4), []).append(zlib.crc32(crc))
    packed, starts = {}, 0
    for r in got:
        starts += r.start == 0
        packed.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert starts == sum(map(len, copies.values())) and set(packed) == set(copies)
    for key, pieces in packed.items():
        assert sum(r.length for r in pieces) == key[1] * len(copies[key])
        assert {r.ids_crc32 for r in pieces if r.length == key[1]} <= set(copies[key])
    total = sum(r.length for r in got)
    assert max(r.sequence_id for r in got) == (total - 1) // 4096
    # Each source's words come near its target.
    for _, own in mixing.mix(docs).toPandas().groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() / 2 + 1


def test_an_empty_table(spark, tmp_path, none):
    assert run(spark, none, tmp_path) == []


def test_stages_return_the_columns_of_documents(docs, spark):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "suffix-array dedup", "mixing", "packing"]


@given_tables
def test_bytes_of_the_given_documents(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op4_suffixes(spark, SF).collect())
    assert got == sorted(cut_bytes(rows, 100))


@given_tables
def test_languages_of_the_given_documents(spark):
    """Nearly all held-out documents with a known language are right."""
    known = read_table(spark, SF, "documents").where("lang is not null").select("doc_id", "lang")
    rows = Q.op3_langid(spark, SF).where("held_out and lang_pred <> 'und'").join(known, "doc_id").select((F.col("lang") == F.col("lang_pred")).alias("right")).collect()
    assert len(rows) >= 20 and sum(r.right for r in rows) >= 0.95 * len(rows)


@given_tables
def test_near_copies_by_all_pairs_of_the_given_documents(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted(brute(rows, 5, 80)) and suffixes.CHUNK > 0
