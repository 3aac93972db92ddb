"""Quality rules, language identification, chat formatting, URLs, top-k search."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from sparklog.llm import chat, langid, quality, search, urls
from sparklog.llm.queries import HOSTILE, URL_RULES
from tests.llm.conftest import prose


def base(text):
    w = (text or "").encode().split()
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)} if len(runs) < 2000 else None
    lines, seen, twice = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            twice += line in seen
            seen.add(line)
    return len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in text or ""), twice, None if covered is None else len(covered)


def test_quality_figures(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for d in docs.select("doc_id", "text").collect():
        r, want = got[d.doc_id], base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        if want[4] is not None:
            assert r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_lines():
    fails = lambda s: quality.line_fails(s.encode(), s.encode().split())
    assert fails("one%%% two*** three### four$$$") == "punctuation"
    assert fails("THIS IS A LOUD LINE WITH CAPITALS!! ONLY!!") == "punctuation"
    assert fails("Home | About | Login | Cart") == "navigation"
    assert fails("Home About Login") == "navigation"
    assert fails("Copyright (c) 2020, all rights reserved.") == "boilerplate"
    assert fails("spam " * 12) == "boilerplate"
    assert fails("A plain line, with a comma and a full stop.") is None


def test_quality_rejects_what_loses_too_much(spark):
    good, bad = prose(1, 100), "\n".join(f"WORD{i}!! LOUD{i}!! NOISE{i}!! CRY{i}!!" for i in range(40))
    docs = spark.createDataFrame([(1, good + "\nAll rights reserved.", 5), (2, bad, 5), (3, prose(2, 100) + "\n" + bad, 5)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert got == {1: True, 2: False, 3: False}
    out = quality.clean(docs)
    (r,) = out.collect()
    assert out.columns == docs.columns and r.text == good and r.n_chars == len(good)


def test_quality_keeps_long_lines_with_a_notice(spark):
    """One phrase of a notice fails a short line, not a long paragraph or a document in one line."""
    fails = lambda s: quality.line_fails(s.encode(), s.encode().split())
    assert fails("Click here to see the whole list of results") == "boilerplate"
    text = " ".join(prose(3, 400).split()).replace(" ", " read more ", 1)
    assert len(text.split("\n")) == 1 and fails(text) is None
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars int")
    (r,) = quality.quality(docs).collect()
    assert r.kept and (r.n_lines_failed, r.chars_failed) == (0, 0)
    assert [r.text for r in quality.clean(docs).collect()] == [text]


def test_language_held_out(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ber", "sch", "keit", "ung"], "bb": ["tion", "eau", "ment", "que"]}
    rows = []
    for i in range(300):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(60)), lang if i % 11 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.train(train)
    got = langid.identify(docs.drop("lang"), model).join(docs, "doc_id").where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    # A switch in the middle: each half's words go to its own language.
    half = lambda lang: [("".join(rng.choice(syllables[lang]) for _ in range(3))).encode() for _ in range(40)]
    index, table = model.lookup(half("aa") + half("bb"))
    post = langid.forward_backward(table[index], langid.np.array([80]), model.transitions, model.start)
    assert (post[:40].argmax(axis=1) == 0).mean() > 0.95 and (post[40:].argmax(axis=1) == 1).mean() > 0.95
    assert sorted(map(str, langid.identify(docs, langid.train(train)).collect())) == sorted(map(str, langid.identify(docs.repartition(5), model).collect()))


def test_language_of_short_texts(spark):
    """Languages of short documents only, one of them without spaces, are learned beside one of long documents."""
    rng = random.Random(8)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    text = {"aa": lambda: " ".join(pick("abcdefg", 6) for _ in range(60)), "bb": lambda: " ".join(pick("stuvwxyz", 6) for _ in range(8)), "zh": lambda: pick("的一是不了人我在有他这为之大来以个中上们", 20)}
    rows = [(i, text[lang](), lang) for i, lang in enumerate(["aa", "bb", "zh"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs, model).join(docs, "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    assert {r.lang for r in got} == set(text) and all(r.lang == r.lang_pred for r in got)


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "PASSES", 6)
    names = [f"l{i:02}" for i in range(70)]
    words = {lang: [chr(0x4E00 + 40 * i + j) * 3 for j in range(8)] for i, lang in enumerate(names)}
    rows = [(100 * i + j, " ".join(words[lang]), lang) for i, lang in enumerate(names) for j in range(1 + (i < 64))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.labels == names
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, model).join(docs, "doc_id").collect())


def test_forward_backward_sums_over_all_paths():
    import itertools

    np = langid.np
    rng = np.random.default_rng(0)
    scores, move, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.forward_backward(scores, np.array([4, 0, 3]), move, start)
    for first, n in ((0, 4), (4, 3)):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.exp(start[path[0]] + sum(scores[first + i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            for i, p in enumerate(path):
                want[i, p] += weight
        assert np.allclose(got[first : first + n], want / want.sum(axis=1, keepdims=True))


def test_language_edges(docs, none):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for d in docs.select("doc_id", "text").collect():
        r = got[d.doc_id]
        letters = any(c.isalpha() for c in d.text or "")
        assert (r.lang_pred in ("en", "de")) == letters and 0 <= r.score <= 1
        assert letters or (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(none, model).collect() == []
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


CHATS = [
    (1, 0, "system", "be <|im_end|> kind"),
    (1, 2, "assistant", "100% %25 %3C|"),
    (1, 1, "user", "hi\nthere"),
    (1, 3, "assistant", "more\n"),
    (1, 3, "assistant", "more\n"),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (2, None, None, "no role"),
    (3, 0, "assist\nant", "a role of two lines"),
    (3, 1, "", ""),
    (None, 0, "user", "nobody's"),
    (-1, 0, "user", HOSTILE),
    (-1, 1, "assistant", HOSTILE),
    (4, 0, "assistant", "x" * 100_000),
    (4, 1, "assistant", "<|im_turn|>" * 50),
]


def test_chats_are_read_back(spark):
    turns = spark.createDataFrame([(*c, 7, "f") for c in CHATS], "conv_id long, turn long, role string, text string, blocks int, formatted string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(turns)).collect()}
    by: dict = {}
    for conv, turn, role, text in CHATS:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        r = got[conv]
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_blocks_merge_one_role(spark):
    turns = spark.createDataFrame(CHATS[:5], "conv_id long, turn long, role string, text string")
    (r,) = chat.format_chats(turns).collect()
    assert r.formatted.count(chat.START) == 3 and r.formatted.count(chat.TURN) == 2 and len(r.loss_mask) == 3
    assert chat.format_chats(turns.limit(0)).collect() == []


URLS = [
    (1, "https://M.Example.org/es/1", "m.example.org", "/es/1", "example.org/es/"),
    (2, "http://example.org/en/12?q#x", "example.org", "/en/12", "example.org/en/1"),
    (3, "http://example.org/en/2", "example.org", "/en/2", "org/"),
    (4, "http://example.org", "example.org", "", None),
    (5, "http://a.com/de/9.html", "a.com", "/de/9.html", "com/de/"),
    (6, "http://acom/de/9", "acom", "/de/9", None),
    (7, "no scheme", "", "", None),
    (8, None, "", "", None),
    (9, "x://y://z/a", "y:", "//z/a", None),
    (10, "http://b.com?x=/fr/", "b.com", "", None),
    (11, "http://ÄB.com/fr/é", "Äb.com", "/fr/é", "com/fr/"),
    (12, "http://long.net/" + "s" * 5000 + "/a/b/c/d/e/f/g/h", "long.net", "/" + "s" * 5000 + "/a/b/c/d/e/f/g/h", None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "h") for i, u, *_ in URLS] * 2, "page_id long, url string, shape int, template string")
    rows = urls.judge_urls(pages, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS)
    got = {r.page_id: r for r in rows}
    said = {r: v for v, r in URL_RULES}
    for i, _, host, path, rule in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (said[rule] if rule else "block" if r.purity > urls.PURITY else "allow")
    assert urls.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_url_branches_split_by_purity(spark):
    """A branch that is blocked as a rule stays apart, and its unlabelled pages are rejected."""
    rows = [(i, f"http://h.example.com/{'de' if i % 2 else 'news'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block", "example.com/de/1"), ("allow", "example.com/news/1")]
    got = {r.page_id: r for r in urls.judge_urls(pages, rules).collect()}
    assert got[3].rule is None and got[3].verdict == "block" and got[3].template == "/de/*"
    assert got[4].rule is None and got[4].verdict == "allow" and got[4].template == "/news/*"


def test_url_branches_split_at_depth(spark):
    """Branches that differ in their sixth segment stay apart."""
    at = lambda i: "a/b/c/d/e/" + ("ads" if i % 2 else "news")
    pages = spark.createDataFrame([(i, f"http://h.example.com/{at(i)}/{i}") for i in range(200)], "page_id long, url string")
    rules = [("block", f"example.com/{at(1)}/1"), ("allow", f"example.com/{at(0)}/1")]
    got = {r.page_id: r for r in urls.judge_urls(pages, rules).collect()}
    assert got[3].rule is None and got[3].verdict == "block" and got[3].template.endswith("/ads/*")
    assert got[4].rule is None and got[4].verdict == "allow" and got[4].template.endswith("/news/*")


def test_url_branch_of_many_stays_apart(spark):
    """A blocked branch with 2 % of a host's pages stays apart from 49 siblings, and these from it."""
    names = ["ads", *(a + b for a in "bcdefgh" for b in "stuvwxy")]
    pages = spark.createDataFrame([(100 * k + i, f"http://h.example.com/{name}/{i}") for k, name in enumerate(names) for i in range(40)], "page_id long, url string")
    rules = [("block" if name == "ads" else "allow", f"example.com/{name}/1") for name in names]
    got = {r.page_id: r for r in urls.judge_urls(pages, rules).collect()}
    assert len(names) == 50 and got[3].rule is None and (got[3].template, got[3].verdict) == ("/ads/*", "block")
    assert {(got[100 * k + 3].template, got[100 * k + 3].verdict) for k in range(1, 50)} == {("/*/*", "allow")}


def test_similar_url_branches_merge_with_each_other(spark):
    """Blocked branches with few pages below them are one template, as are clean ones."""
    names = ["ads", "spam", "promo", "news", "docs", "blog"]
    pages = spark.createDataFrame([(1000 * k + i, f"http://h.example.com/{name}/{i}/x") for k, name in enumerate(names) for i in range(60)], "page_id long, url string")
    rules = [("block" if k < 3 else "allow", f"example.com/{name}/1") for k, name in enumerate(names)]
    got = {r.page_id: r for r in urls.judge_urls(pages, rules).collect()}
    found = [{(got[1000 * k + i].template, got[1000 * k + i].verdict) for i in (3, 25, 47)} for k in range(6)]
    assert found[:3] == [{("/{share 4}/*/*", "block")}] * 3 and found[3:] == [{("/{share 0}/*/*", "allow")}] * 3


def test_topk_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(96)]) for i in range(150)]
    hot = [0.5] * 96
    rows += [(200 + i, hot) for i in range(60)] + [(300, None), (301, []), (302, [None, float("nan"), 0.0, -1.0]), (303, [1.0] * 64), rows[0]]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rep int")
    got = search.topk(vectors, F.col("vec_id") % 50 == 0, k=7).collect()
    code = lambda v: sum(1 << j for j, x in enumerate(v) if x is not None and (x > 0 or x != x))
    coded = [(i, code(v)) for i, v in rows if v is not None]
    want = []
    for q, c in coded:
        if q % 50 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in coded)[:7]
            want += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == sorted(want)


def test_topk_of_few(spark, none):
    vectors = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = search.topk(vectors, F.lit(True), k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == [(0, 1, 0, 0), (0, 2, 1, 1), (1, 1, 1, 0), (1, 2, 0, 1)]
    assert search.topk(vectors.limit(0), F.lit(True)).collect() == []


def test_a_conversation_of_many_turns(spark):
    """Spans stay right over many chunks, and the work doesn't grow with the square of the turns."""
    n = 16_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("tür <| "), F.col("id")).alias("text"))
    began = time.perf_counter()
    (r,) = chat.digests(chat.format_chats(turns)).collect()
    assert time.perf_counter() - began < 60
    said = "".join(f"tür <| {i}" for i in range(n) if i % 3)
    assert r.n_turns == n and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_menus_separators_and_links_are_navigation():
    fails = lambda s: quality.line_fails(s.encode(), s.encode().split())
    assert fails("Inicio | Noticias | Deportes | Contacto") == "navigation" == fails("Start > Kultur > Musik")
    assert fails("siehe http://a.example/x und www.b.example/y hier") == "navigation"
    assert fails("Ein Satz mit einem | darin, der sonst ganz gewöhnlich ist und bleibt.") is None
    assert quality.menus([(1, False)] * 5 + [(9, True)] + [(1, False)] * 4) == [True] * 5 + [False] * 5
    body = prose(3, 100)
    figures = quality.judge(("Über uns\nImpressum\nDatenschutz\nHilfe\nKontakt\n" + body).encode())
    assert figures[6:11] == (14, 5, 0, 5, 0) and figures[-2] and figures[-1].decode() == body

