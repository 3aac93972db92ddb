import zlib

import numpy as np
import pytest

from sparklog.llm import mixing, packing
from sparklog.llm.queries import tokenizer_path

TRICKY = ["Don't STOP, it's O'Neill's 3rd café!!", "<|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ ΟΔΟΣ ǅ é́", "a\u00a0b\u2003c\x1cd", "ﬁ½²x_y--z", "日本語 テスト 12345", "naïve Größe ŁÓDŹ", "e\u0301a\u0308", "''s 'S 'll", "_a__b", "ABC,!! d.e.f", "x" * 500]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_whole_texts(tokenizer, texts):
    encode = packing.WordEncoder(tokenizer_path()).encode
    for text in [*TRICKY, " ".join(TRICKY), *[t for t in texts if t]]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(texts, name):
    from tokenizers import Tokenizer

    own, made = Tokenizer.from_file(tokenizer_path(name)), packing.WordEncoder(tokenizer_path(name))
    assert made.by_word == (name == "word_bpe_49k.json")
    for text in [t for t in texts if t is not None][:14] + ["Don't  STOP\n\tit's 12 naïve ﬁn"]:
        assert np.frombuffer(made.encode(text.encode()), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_full_caches_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    encode = packing.WordEncoder(tokenizer_path()).encode
    for text in TRICKY:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [4096, 64])
def test_pieces(docs, tokenizer, length):
    rows = packing.pack(docs, tokenizer_path(), length).collect()
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id] = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
    by: dict = {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and 0 < r.length <= length
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = []
    for k in sorted(by):
        at = 0
        for offset, n in sorted(by[k]):
            assert offset == at
            at += n
        used.append(at)
    assert sorted(by) == list(range(len(by))) and all(n == length for n in used[:-1])
    # Every token once; the repeated row counts twice.
    assert sum(used) == sum(len(ids[r.doc_id]) for r in docs.select("doc_id").collect())


def test_targets_share_and_stop():
    got = mixing.targets([("a", 100), ("b", 10), ("c", 1000), (None, 50)])
    assert got["b"] == 30.0 and sum(got.values()) == pytest.approx(1160)
    assert all(got[s] <= 3 * n for s, n in (("a", 100), ("b", 10), ("c", 1000), (None, 50)))
    assert mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    largest: dict = {}
    taken: dict = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for r in rows:
        assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1


def test_mix_is_close_with_many_documents(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(5 + id % 90 as int)) as text", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'x' end as source")
    rows = mixing.mix(docs).groupBy("source").sum("taken").collect()
    want = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for r in rows:
        assert abs(r[1] - want[r.source]) <= 50


def test_inclusion_follows_the_chances(spark):
    """Chances are calibrated to the rest, unequal, 1 for some, and documents come in as often as they say."""
    size = "case when id % 50 = 0 then 4000 when id % 3 = 0 then 10 when id % 3 = 1 then 40 else 160 end"
    docs = spark.range(9000).selectExpr("id as doc_id", f"repeat('w ', cast({size} as int)) as text", "case when id % 2 = 0 then 'a' else 'b' end as source")
    rows = mixing.mix(docs, weight=lambda n: n).toPandas()
    assert {"a", "b"} == set(rows["source"])
    drawn = 0
    for _, own in rows.groupby("source"):
        certain = int(own["target"].iloc[0] // own["source_size"].iloc[0])
        rest = own["target"].iloc[0] - certain * own["source_size"].iloc[0]
        assert (own["chance"] * own["size"]).sum() == pytest.approx(rest)
        extra = own["copies"] - certain
        assert set(extra) <= {0, 1} and abs((extra * own["size"]).sum() - rest) <= 2000
        for chance, same in own.assign(extra=extra).groupby("chance"):
            n, got = len(same), same["extra"].sum()
            assert abs(got - n * chance) <= 5 * (n * chance * (1 - chance)) ** 0.5 + 0.5
            drawn += 0 < chance < 1
        assert own["chance"].nunique() >= 3
    assert drawn >= 5


def test_repeated_rows_are_taken_one_by_one(spark):
    docs = spark.range(600).selectExpr("case when id < 300 then 7 when id < 400 then null else id end as doc_id", "'one two three four' as text", "case when id % 2 = 0 then 'a' else 'b' end as source")
    rows = mixing.mix(docs).toPandas()
    for source, own in rows.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 2
        assert mixing.mixed(docs).where(f"source = '{source}'").count() == own["copies"].sum()


def test_mixed_rows(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want: dict = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (r.copies if r.size else 0)
    assert n == {d: c for d, c in want.items() if c}


def test_empty_tables(none):
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    assert packing.pack(none, tokenizer_path()).collect() == []
