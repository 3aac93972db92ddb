"""Quality rules, lines first: failing lines go, then documents that lose too much.

Each line with a word is judged alone by rules on punctuation, navigation and
boilerplate. The lines that pass are the cleaned text. A document is rejected
when its base figures fail or when the failed lines held more than
``MOST_LOST`` of its word characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import pieces, utf8

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_lines_failed long, n_punctuation long, n_navigation long, n_boilerplate long, chars_failed long, kept boolean, cleaned string"

LEAST_WORDS = 50
#: Share of words in repeated 3-word windows above which a text fails, in hundredths.
MOST_REPEATED = 50
#: Share of a document's word characters that failed lines may hold.
MOST_LOST = 0.5
#: Signs for each word of a line, above which it fails.
MOST_SYMBOLS = 0.5
MOST_SHOUTS = 0.5
#: Share of capitals among a line's letters, for lines of this many letters.
MOST_CAPITALS, CAPITALS_FROM = 0.7, 20
#: Share of a line's words that one word may make up, for lines of this many words.
MOST_OF_ONE_WORD, ONE_WORD_FROM = 0.3, 10
#: A navigation line has at most so many words, and this share of them from the list.
NAVIGATION_WORDS, NAVIGATION_SHARE = 12, 0.5
#: Share of a line's words from which the phrases of notices in it make it one.
NOTICE_SHARE = 0.1

#: A line is navigation from these shares of separators, and of links, among its words.
SEPARATOR_SHARE, LINK_SHARE = 0.25, 0.3
#: Lines in a row of at most so many words without a sign at their end, as in menus, that make each other navigation.
MENU_LINES, MENU_WORDS = 5, 3

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SEPARATORS = frozenset(x.encode() for x in ("|", ">", ">>", "/", "»", "·", "•", "›"))
ENDS = tuple(x.encode() for x in ".!?:;,\"')]…”»。！？।")
# Words of site navigation, and phrases of legal and site notices.
NAVIGATION = frozenset(b"home menu login logout register search sitemap contact about next previous back top share print subscribe newsletter account cart checkout".split())
BOILERPLATE = re.compile(rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|click here|read more|sign up for|subscribe to our|copyright (?:\(c\)|\xc2\xa9)|powered by|lorem ipsum", re.I)


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with these words fails, or None."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols > MOST_SYMBOLS * n or line.count(b"!") > MOST_SHOUTS * n:
        return "punctuation"
    lower = line.lower()
    if lower != line and len(line) >= CAPITALS_FROM:
        text = line.decode("utf-8", "replace")
        letters = sum(map(str.isalpha, text))
        if letters >= CAPITALS_FROM and sum(map(str.isupper, text)) > MOST_CAPITALS * letters:
            return "punctuation"
    if sum(w in SEPARATORS for w in words) >= SEPARATOR_SHARE * n or sum(b"://" in w or w.startswith(b"www.") for w in words) >= LINK_SHARE * n:
        return "navigation"
    if n <= NAVIGATION_WORDS and sum(w.strip(b".,:;|>-").lower() in NAVIGATION for w in words) >= NAVIGATION_SHARE * n:
        return "navigation"
    notices = BOILERPLATE.findall(line)
    if notices and sum(len(x.split()) for x in notices) >= NOTICE_SHARE * n:
        return "boilerplate"
    if n >= ONE_WORD_FROM and max(Counter(words).values()) > MOST_OF_ONE_WORD * n:
        return "boilerplate"
    return None


def menus(lines: list[tuple[int, bool]]) -> list[bool]:
    """Which of the lines (words, ends with a sign) stand in a run of short lines without a sign."""
    out, start = [False] * len(lines), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or lines[i][0] > MENU_WORDS or lines[i][1]:
            if i - start >= MENU_LINES:
                out[start:i] = [True] * (i - start)
            start = i + 1
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that come twice or more."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    keys = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] ^ (h[2:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def judge(text: bytes) -> tuple:
    """The figures of one text, in the order of ``FIGURES``."""
    words = text.split()
    n = len(words)
    inside = text.translate(None, WHITE)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    lines = [(line, line.split()) for line in text.split(b"\n")]
    menu = menus([(len(own), own[-1].endswith(ENDS)) for _, own in lines if own])
    seen: set[bytes] = set()
    kept_lines, duplicates, lost, worded = [], 0, 0, 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line, own in lines:
        if not own:
            kept_lines.append(line)
            continue
        again, rule = line in seen, None
        if again:
            duplicates += 1
        else:
            seen.add(line)
            rule = line_fails(line, own) or ("navigation" if menu[worded] else None)
        worded += 1
        if rule:
            failed[rule] += 1
        if again or rule:
            lost += sum(map(len, own)) if line.isascii() else len(b"".join(own).decode("utf-8", "replace"))
        else:
            kept_lines.append(line)
    base = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
    kept = not base and lost <= MOST_LOST * chars
    return n, chars, symbols, duplicates, repeats, base, worded, duplicates + sum(failed.values()), *failed.values(), lost, kept, b"\n".join(kept_lines) if kept else None


def quality(docs: DataFrame, cleaned: bool = False) -> DataFrame:
    """Judges every document; with ``cleaned``, also gives the text that is left.

    Returns doc_id and ``FIGURES``: word_chars are code points in words,
    n_dup_lines lines with a word that equal an earlier line, n_repeat_words
    words in 3-word windows found twice or more; n_punctuation, n_navigation and
    n_boilerplate count lines by the rule they fail first. A repeated line fails
    like one that a rule rejects. A null or empty text has no words, so it fails. Each
    row is judged by itself, so repeated rows and doc_ids do no harm; other
    columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = list(zip(*map(judge, utf8(batch.column(1))), strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 6 + [pa.bool_()]
            arrays = [pa.array(c, k) for c, k in zip(columns[:-1], kinds, strict=True)]
            text = pa.array(columns[-1] if cleaned else [None] * batch.num_rows, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, text], names=["doc_id", *(f.split()[0] for f in FIGURES.split(", "))])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + FIGURES)
    return out if cleaned else out.drop("cleaned")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without rejected documents and failed lines; its columns stay as they are.

    An ``n_chars`` column follows the cleaned text. Documents are judged row by
    row, whatever their doc_id.
    """
    fields = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = fields.index("text")
        for batch in pieces(batches, text=at):
            found = [judge(x) for x in utf8(batch.column(at))]
            keep = pa.array([f[-2] for f in found])
            columns = list(batch.columns)
            columns[at] = pa.array([f[-1] for f in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=fields).filter(keep)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in fields else out
