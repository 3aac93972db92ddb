"""Language identification by a linear-chain conditional random field.

Each word of a text is labelled with a language. A label's score is a sum of
weights of byte n-grams, of affixes (n-grams that hold a word's border) and of
the word itself as a lexicon entry; neighbouring labels are tied by learned
transitions, so that a text may switch languages. Forward-backward gives every
word's label probabilities, and a document's language is the one with the most
probability over its words.

The model learns from a bounded sample: ``PER_LANGUAGE`` labelled documents of
every language, of any length, cut into spans and spliced so that the training
sequences contain switches. A span goes on in another document of its language
where one is too short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.llm.fingerprints import mix
from sparklog.llm.shared import WORD, pieces, utf8

#: Bound of the training sample of each language.
PER_LANGUAGE = 250
#: Sequences for training, their words, and passes over them.
SEQUENCES, LENGTH, PASSES, RATE, DECAY = 3000, 24, 40, 0.15, 1e-4
#: Sequences that begin with each language, at least.
LEAST_SEQUENCES = 48
#: Hashed weights of n-grams and of words.
BUCKETS, LONGEST = 1 << 16, 4
#: Words whose scores a worker keeps, and bytes of text that it labels at a time; both for up to ``FEW`` languages, and less in proportion for more.
CACHE_ENTRIES = 400_000
CHUNK = 8_000_000
FEW = 8

RESULT = "doc_id long, lang_pred string, score double"


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with their borders: (word, bucket)."""
    framed = b"".join([b"\x02" + w + b"\x03" for w in words])
    text = np.frombuffer(framed, np.uint8).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    index, bucket = [], []
    for n in range(1, LONGEST + 1):
        code = np.full(max(len(text) - n + 1, 0), n, np.uint64)
        for j in range(n):
            code = code << np.uint64(8) | text[j : len(text) - n + 1 + j]
        inside = own[: len(code)] == own[n - 1 :]
        if n == 1:
            inside &= text > 3
        index.append(own[: len(code)][inside])
        bucket.append((mix(code[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(index), np.concatenate(bucket)


def entries(words: list[bytes]) -> np.ndarray:
    """Hashed lexicon entries of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in words), np.int64, len(words))


def has_letter(word: bytes) -> bool:
    if word.isascii():
        return bool(word.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) and any(map(str.isalpha, word.decode()))
    return any(map(str.isalpha, word.decode("utf-8", "replace")))


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    cache: dict[bytes, int] = field(default_factory=dict)
    kept: np.ndarray | None = None

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Label scores of distinct words; zero for words without a letter."""
        k = len(self.labels)
        out = np.zeros((len(words), k), np.float32)
        some = [i for i, w in enumerate(words) if has_letter(w)]
        if some:
            lettered = [words[i].lower() for i in some]
            index, bucket = grams(lettered)
            for j in range(k):
                out[some, j] = np.bincount(index, self.grams[bucket, j], len(some))
            out[some] += self.lexicon[entries(lettered)]
        return out

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word in a table of scores, and the table."""
        if self.kept is None:
            self.kept = np.zeros((0, len(self.labels)), np.float32)
        known, fresh, order = self.cache, {}, []
        for w in words:
            i = known.get(w)
            if i is None:
                i = fresh.get(w)
                if i is None:
                    i = fresh[w] = len(known) + len(fresh)
            order.append(i)
        table = np.concatenate([self.kept, self.scores(list(fresh))]) if fresh else self.kept
        if len(known) + len(fresh) <= CACHE_ENTRIES * FEW // max(len(self.labels), FEW):
            known.update(fresh)
            self.kept = table
        return np.array(order, np.int64), table


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of several texts, whose words follow each other.

    Texts advance in step, longest first, so step t handles the texts with more
    than t words at once.
    """
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    move = np.exp(transitions - transitions.max())
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = begin[order], lengths[order]
    most = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(most), side="left").tolist()  # texts longer than t
    alpha = np.empty_like(potential)
    state = None
    for t in range(most):
        at = begin[: active[t]] + t
        state = np.exp(start) * potential[at] if t == 0 else (state[: active[t]] @ move) * potential[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    beta = np.ones((0, potential.shape[1]))
    for t in range(most - 1, -1, -1):
        n = active[t]
        grown = np.ones((n, potential.shape[1]))
        grown[: len(beta)] = beta
        at = begin[:n] + t
        post = alpha[at] * grown
        alpha[at] = post / post.sum(axis=1, keepdims=True)
        beta = (potential[at] * grown) @ move.T
        beta /= beta.sum(axis=1, keepdims=True)
    return alpha


def spliced(texts: list[tuple[str, bytes]], seed: int) -> tuple[list[bytes], np.ndarray]:
    """Training sequences of ``LENGTH`` words, half of them with a switch: words and languages.

    The languages take turns in beginning a sequence, so each has its share.
    """
    rng = np.random.default_rng(seed)
    by: dict[str, list[list[bytes]]] = {}
    for lang, text in texts:
        if words := text.split():
            by.setdefault(lang, []).append(words)
    langs = sorted(by)
    words, labels = [], []

    def span(lang: str, n: int) -> list[bytes]:
        out: list[bytes] = []
        while len(out) < n:
            own = by[lang][rng.integers(len(by[lang]))]
            size = min(n - len(out), len(own))
            at = rng.integers(len(own) - size + 1)
            out += own[at : at + size]
        return out

    for i in range(max(SEQUENCES, LEAST_SEQUENCES * len(langs)) if langs else 0):
        first = LENGTH if rng.random() < 0.5 else int(rng.integers(1, LENGTH))
        for lang, n in ((langs[i % len(langs)], first), (langs[rng.integers(len(langs))], LENGTH - first)):
            if n:
                words += span(lang, n)
                labels += [lang] * n
    return words, np.array(labels)


def fit(texts: list[tuple[str, bytes]], seed: int = 0) -> Model:
    """The model of (language, text) pairs, by gradient ascent on the conditional likelihood.

    A language without a word with a letter has nothing to learn from and is no label.
    """
    worded = {lang for lang, text in texts if any(map(has_letter, text.split()))}
    texts = [(lang, text) for lang, text in texts if lang in worded]
    labels = sorted({lang for lang, _ in texts}, key=lambda s: [ord(c) for c in s])
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    words, said = spliced(texts, seed)
    if not words or k < 2:
        return model
    names = {x: i for i, x in enumerate(labels)}
    truth = np.eye(k, dtype=np.float32)[[names[x] for x in said.tolist()]]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    token = np.array([vocabulary[w] for w in words])
    distinct = [w.lower() for w in vocabulary]
    lettered = np.array([has_letter(w) for w in vocabulary])
    index, bucket = grams(distinct)
    used = lettered[index]
    index, bucket, entry = index[used], bucket[used], entries(distinct)
    lengths = np.full(len(words) // LENGTH, LENGTH)
    moments = {name: [np.zeros_like(getattr(model, name), np.float64), np.zeros_like(getattr(model, name), np.float64)] for name in ("grams", "lexicon", "transitions", "start")}
    pairs = truth.reshape(-1, LENGTH, k)
    seen = sum((pairs[:, t].T.astype(np.float64) @ pairs[:, t + 1] for t in range(LENGTH - 1)), np.zeros((k, k)))
    for turn in range(1, PASSES + 1):
        scores = np.stack([np.bincount(index, model.grams[bucket, j], len(distinct)) for j in range(k)], axis=1) + model.lexicon[entry] * lettered[:, None]
        emitted = scores[token]
        post = forward_backward(emitted, lengths, model.transitions, model.start)
        gap = (truth - post) * lettered[token][:, None]
        word_gap = np.stack([np.bincount(token, gap[:, j], len(distinct)) for j in range(k)], axis=1)
        gradient = {
            "grams": np.stack([np.bincount(bucket, word_gap[index, j], BUCKETS) for j in range(k)], axis=1),
            "lexicon": np.stack([np.bincount(entry, word_gap[:, j], BUCKETS) for j in range(k)], axis=1),
            "transitions": seen - expected_moves(emitted, model, lengths),
            "start": (pairs[:, 0] - post.reshape(-1, LENGTH, k)[:, 0]).sum(axis=0),
        }
        for name, g in gradient.items():
            value = getattr(model, name)
            g = g / len(words) - DECAY * value
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            step = RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
            setattr(model, name, (value + np.where(g == 0, 0, step)).astype(value.dtype))
    return model


def expected_moves(scores: np.ndarray, model: Model, lengths: np.ndarray) -> np.ndarray:
    """Expected number of each transition in sequences of one length."""
    n, k = int(lengths[0]), scores.shape[1]
    potential = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, n, k)
    move = np.exp(model.transitions - model.transitions.max())
    alpha, beta = np.empty_like(potential), np.ones_like(potential)
    state = np.exp(model.start) * potential[:, 0]
    for t in range(n):
        if t:
            state = (state @ move) * potential[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[:, t] = state
    for t in range(n - 2, -1, -1):
        back = (potential[:, t + 1] * beta[:, t + 1]) @ move.T
        beta[:, t] = back / back.sum(axis=1, keepdims=True)
    total = np.zeros((k, k))
    for t in range(n - 1):
        after = potential[:, t + 1] * beta[:, t + 1]
        weight = ((alpha[:, t] @ move) * after).sum(axis=1, keepdims=True)
        total += move * ((alpha[:, t] / weight).T @ after)
    return total


def label_texts(model: Model, texts: list[bytes]) -> list[tuple[str, float]]:
    """(language, score) of each text: the largest mean probability over its words with a letter."""
    parts = [t.split() for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    index, table = model.lookup([w for p in parts for w in p])
    out = [("und", 0.0)] * len(texts)
    if not len(index) or not model.labels:
        return out
    # Words without a letter have no scores and no say.
    lettered = np.abs(table).sum(axis=1) > 0
    post = forward_backward(table[index], lengths, model.transitions, model.start) * lettered[index][:, None]
    full = np.flatnonzero(lengths)
    begin = (np.cumsum(lengths) - lengths)[full]
    sums, counts = np.add.reduceat(post, begin, axis=0), np.add.reduceat(lettered[index].astype(np.int64), begin)
    for i, total, n in zip(full.tolist(), sums, counts.tolist(), strict=True):
        if n:
            best = int(total.argmax())
            out[i] = (model.labels[best], float(min(total[best] / n, 1.0)))
        elif any(map(has_letter, parts[i])):  # a model without weights
            out[i] = (model.labels[0], 1 / len(model.labels))
    return out


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> Model:
    """Fits a model to a sample of ``labelled`` (doc_id, text, lang).

    Rows without text or lang are left out. About ``per_language`` documents of
    each language are drawn by a hash of doc_id, one at least; the driver holds
    twice as many at most. What the driver needs grows with the number of
    languages.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", place.alias("place"))
    # Documents without a word have nothing to learn from.
    rows = rows.where(F.col("text").rlike(WORD))
    counts = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("chance"), F.min("place").alias("least"))
    # One row per language; texts are not dealt by it.
    drawn = rows.join(F.broadcast(counts), "lang").where((F.col("place") < F.col("chance")) | (F.col("place") == F.col("least")))
    own = W.partitionBy("lang").orderBy("place", "doc_id", "text")
    sample = drawn.withColumn("i", F.row_number().over(own)).where(F.col("i") <= 2 * per_language).select("doc_id", "lang", "text").collect()
    return fit([(r["lang"], r["text"].encode()) for r in sorted(sample, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))], seed)


_models: dict[int, Model] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The language of each row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    ``und`` with score 0 for a null or empty text and one without a letter. Texts
    are read whole, whatever their length. Rows are labelled one by one, so
    repeated rows and doc_ids do no harm; other columns, lang among them, are not
    read. An empty table gives no rows. A model of one language gives it to every
    text with a letter, one of none gives ``und``.
    """
    weights = (model.labels, model.grams, model.lexicon, model.transitions, model.start)
    stamp = xxhash.xxh3_64_intdigest(b"".join(np.ascontiguousarray(w).tobytes() for w in weights[1:]) + repr(model.labels).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _models:
            _models.clear()
            _models[stamp] = Model(*weights)
        for batch in pieces(batches, most=CHUNK * FEW // max(len(model.labels), FEW)):
            found = label_texts(_models[stamp], utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)
