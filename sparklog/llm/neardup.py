"""Near-duplicate documents by SetSketch.

A register of a document's sketch is a truncated, exponentially spaced minimum
over its shingles, so sketches merge by maximum and similar sets agree in many
registers. Bands of registers bring candidates together; of each pair the
Jaccard index is estimated by the joint likelihood of greater, smaller and equal
registers; pairs that may reach the threshold are confirmed on the full sets. Every link has
passed both, however it was met.

Copies, documents with one shingle set, are one class from the start. In a
band's bucket every class is compared with the smallest one, its head, first.
Classes that this leaves outside their head's component are then compared with
all classes of other components around that head: as pairs where these are few,
else in blocks by matrix products. So a bucket's pairs are never spelled out,
and yet no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.fingerprints import mix, pack_arrays, rolling, unpack_arrays
from sparklog.llm.shared import Scratch, pieces, utf8
from sparklog.llm.substrings import runs, starts_of

#: Registers, base of their scale, rate of the exponential variables and largest value.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 1
#: Chance that a pair at the threshold shares no band.
MISS = 1e-8
#: How far below the threshold an estimate may be; over six standard deviations of 256 registers.
MARGIN = 0.15

#: Around one head, strays times mates up to this multiple of their sum are spelled out as pairs; beyond, blocks of this size are compared.
SPELLED_OUT, BLOCK = 4, 1000

CHUNK = 4_000_000


def band_rows(threshold: float, registers: int = REGISTERS) -> int:
    """The most registers a band may have for the chance of a miss at the threshold to stay within ``MISS``."""
    return max(r for r in range(1, registers + 1) if r == 1 or (1 - threshold**r) ** (registers // r) <= MISS)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of 64 bits, sorted by text and hash; and the text of each.

    Texts are lower-cased in A-Z. A text with fewer words than ``width`` has one
    shingle, its whole sequence; a text without words has none.
    """
    digest, parts = xxhash.xxh3_64_intdigest, []
    for text in texts:
        words = text.lower().split()
        if 0 < len(words) < width:
            words = [b" ".join(words)] + [b""] * (width - 1)  # no other text has empty words
        parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
    counts = np.array([len(p) for p in parts], np.int64)
    at, doc, _ = starts_of(counts, width)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = rolling(np.concatenate(parts), width, 0x9E3779B97F4A7C15)[at]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = runs(key, doc)
    return key[first], doc[first]


def sketches(key: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers of each document, whose elements are given with their document.

    Every element is a Poisson process of points that fall on registers at
    random, so the first point on each register is exponential and independent
    of the others. Points beyond all of a document's minima can't change it.
    """
    least = np.full(docs * registers, np.inf)
    x, element, turn = np.zeros(len(key)), mix(key), 0
    while len(element):
        turn += 1
        bits = mix(element + np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1))
        x -= np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (registers * RATE)
        np.minimum.at(least, doc * registers + (bits % np.uint64(registers)).astype(np.int64), x)
        if turn <= 16 or turn % 8 == 0:
            first = runs(doc)
            most = least.reshape(docs, registers)[doc[first]].max(axis=1)
            alive = x <= np.repeat(most, np.diff(np.append(first, len(doc))))
            x, element, doc = x[alive], element[alive], doc[alive]
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least) / math.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, value), 0, TOP).astype(np.uint16).reshape(docs, registers)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard index of pairs of sketches by maximum likelihood, given the sizes of the sets."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    scale = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * scale) / math.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        parts = ((up, more), (down, less), (same, 1 - more - less))
        return sum(n * np.log(np.maximum(q, 1e-12)) for n, q in parts)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        better = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(better, low + third, low), np.where(better, high, high - third)
    return (low + high) / 2


def sketch_table(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=CHUNK):
            key, doc = shingles(utf8(batch.column(1)), width)
            n = batch.num_rows
            table = sketches(key, doc, n)
            counts = np.bincount(doc, minlength=n)
            edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
            digest = [xxhash.xxh3_128_digest(key[a:b].tobytes()) if b > a else None for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in table], pa.binary())], names=["doc_id", "n", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch binary")


def band_table(classes: DataFrame, rows: int) -> DataFrame:
    """(band, rep) of each class (rep, n, sketch)."""
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), table.shape[:2]).copy()
            for j in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, j])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["band", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "band long, rep long")


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose estimate comes near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (3, 5))
            found = joint_estimate(x, y, batch.column(2).to_numpy().astype(float), batch.column(4).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(found >= threshold - MARGIN))

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return both.mapInArrow(run, "a long, b long")


def set_table(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the documents in ``wanted`` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=CHUNK):
            key, doc = shingles(utf8(batch.column(1)), width)
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            blocks = [pack_arrays(np.diff(key[a:b], prepend=np.uint64(0))) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.binary())], names=["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.hint("shuffle_hash"), "rep")
    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[bytes, np.ndarray] = {}

        def content(block: bytes) -> np.ndarray:
            if block not in opened:
                if len(opened) > 64:
                    opened.clear()
                opened[block] = np.cumsum(unpack_arrays(block)[0], dtype=np.uint64)
            return opened[block]

        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = content(x), content(y)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def compared(mates: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the strays among ``mates`` (head, rep, own, stray, s, m) with other components around their head.

    Strays and mates are dealt into blocks, and each pair of blocks counts its
    intersections in one matrix product of their shingles. No pair becomes a
    row unless it is a link, and of a stray's links to a component one is kept.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        stray = table.column("left").to_numpy().astype(bool)
        reps, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        sets_ = [np.cumsum(unpack_arrays(b)[0], dtype=np.uint64) for b in table.column("shingles").to_pylist()]
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        rows, columns = np.flatnonzero(stray), np.flatnonzero(~stray)
        links: set[tuple[int, int]] = set()
        if len(rows) and len(columns):
            pick = lambda index: [sets_[i] for i in index.tolist()]
            shared = np.intersect1d(np.concatenate(pick(rows)), np.concatenate(pick(columns)))
            count = np.zeros((len(rows), len(columns)), np.float32)
            # A slice of shingles at a time; sums of ones are exact in 32-bit floats up to 2^24.
            for at in range(0, len(shared), 4096):
                part = shared[at : at + 4096]
                count += _incidence(pick(rows), part) @ _incidence(pick(columns), part).T
            sizes = np.array([len(x) for x in sets_], np.float64)
            union = sizes[rows][:, None] + sizes[columns][None, :] - count
            good = (100 * count.astype(np.float64) >= percent * union) & (own[rows][:, None] != own[columns][None, :])
            seen: set[tuple[int, int]] = set()
            found = np.argwhere(good)
            x, y = rows[found[:, 0]], columns[found[:, 1]]
            near = np.concatenate([joint_estimate(registers[x[a : a + 4096]], registers[y[a : a + 4096]], sizes[x[a : a + 4096]], sizes[y[a : a + 4096]]) for a in range(0, len(found), 4096)] or [np.zeros(0)])
            for i, j in found[near >= percent / 100 - MARGIN].tolist():
                x, y, theirs = int(reps[rows[i]]), int(reps[columns[j]]), int(own[columns[j]])
                if (x, theirs) not in seen:
                    seen.add((x, theirs))
                    links.add((max(x, y), min(x, y)))
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    own_block = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    left = mates.where("stray").withColumn("i", own_block("s")).withColumn("j", numbers("m")).withColumn("left", F.lit(True))
    right = mates.withColumn("j", own_block("m")).withColumn("i", numbers("s")).withColumn("left", F.lit(False))
    dealt = left.select("head", "i", "j", "rep", "own", "left").union(right.select("head", "i", "j", "rep", "own", "left"))
    known = sets.join(classes.select("rep", "sketch"), "rep")
    return dealt.join(known.hint("merge"), "rep").groupBy("head", "i", "j").applyInArrow(run, "a long, b long")


def _incidence(sets: list[np.ndarray], shingles: np.ndarray) -> np.ndarray:
    """Which of the sorted ``shingles`` each set has."""
    out = np.zeros((len(sets), len(shingles)), np.float32)
    for row, x in zip(out, sets, strict=True):
        at = np.searchsorted(x, shingles)
        row[:] = x[np.minimum(at, len(x) - 1)] == shingles
    return out


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of all nodes of ``links`` (a, b): the smallest node that links lead to.

    Labels fall to the smallest among neighbours, and then to the label's own
    label, until nothing changes; every round is a written table.
    """
    both = scratch.save(links.union(links.select("b", "a")), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), f"{name}-0")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).collect()[0][0]
    now, turn = total(labels), 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        lower = scratch.save(lower.join(jump, "label").select("node", F.least("label", "beyond").alias("label")), f"{name}-{turn}")
        scratch.drop(labels)
        labels, last, now = lower, now, total(lower)
        if now == last:
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Components of documents whose shingle sets are alike to ``percent`` of their union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links
    lead to, itself included) and kept (doc_id = component_id).

    A null or empty text, or one without words, has no shingles and no links: it
    is its own component and kept. Rows with one doc_id are one node, whatever
    their texts; repeated rows are answered row by row. A row without doc_id
    takes part in nothing and has null results besides n_shingles. Other columns
    are ignored. An empty table gives no rows. Sizes don't matter to what is
    found; a pair right at the threshold is missed with a chance of ``MISS``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    before = scratch.saved()
    threshold = percent / 100
    table = scratch.save(sketch_table(docs, width), "sketches")
    nodes = table.where("n > 0 and doc_id is not null")
    classes = scratch.save(nodes.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")), "classes")

    bands = band_table(classes, band_rows(threshold))
    shared = bands.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("band", "head")
    # Estimates of sizes know nothing of rows made in Python or by explode: no broadcast where one class becomes many rows.
    buckets = scratch.save(bands.join(shared.hint("merge"), "band"), "buckets")
    stars = scratch.save(buckets.where("rep <> head").groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("bands")), "stars")
    likely = scratch.save(plausible(stars.select("a", "b"), classes, threshold).join(stars, ["a", "b"]), "likely")
    sets = scratch.save(set_table(docs, likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct(), width), "sets")

    # First each class with the head that it shares most bands with, then heads that this hasn't joined it to.
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    links = scratch.save(confirmed(best, sets, percent), "links1")
    labels = components(links, scratch, "components1")

    def apart(pairs: DataFrame) -> DataFrame:
        mark = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        known = pairs.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
        return known.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")

    rest = apart(likely.select("a", "b").join(best, ["a", "b"], "left_anti"))
    more = scratch.save(confirmed(rest, sets, percent), "links2")
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links, scratch, "components2")

    # What is left apart from its head's component is compared with all other components around that head.
    own = labels.select(F.col("node").alias("rep"), F.col("label").alias("own"))
    lead = labels.select(F.col("node").alias("head"), F.col("label").alias("lead"))
    around = stars.select(F.col("a").alias("rep"), F.col("b").alias("head")).join(own, "rep", "left").join(lead, "head", "left")
    around = scratch.save(around.select("head", "rep", F.coalesce("own", "rep").alias("own"), (F.coalesce("own", "rep") != F.coalesce("lead", "head")).alias("stray")), "around")
    sizes = around.groupBy("head").agg(F.count_if("stray").alias("s"), F.count("*").alias("m")).where("s > 0 and m > 1")
    small = F.col("s") * F.col("m") <= SPELLED_OUT * (F.col("s") + F.col("m"))
    mates = scratch.save(around.join(sizes.select("head", "s", "m", small.alias("small")), "head"), "mates")
    if not mates.isEmpty():
        few = mates.where("small")
        theirs = few.select("head", F.col("rep").alias("b"), F.col("own").alias("o"))
        cross = few.where("stray").select("head", F.col("rep").alias("a"), "own").join(theirs, "head").where("own <> o").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        hopeful = scratch.save(plausible(cross, classes, threshold), "hopeful")
        many = mates.where("not small")
        wanted = hopeful.select(F.col("a").alias("rep")).union(hopeful.select("b")).union(many.select("rep")).distinct().join(sets.select("rep"), "rep", "left_anti")
        all_sets = scratch.save(sets.union(set_table(docs, wanted, width)), "all_sets")
        found = scratch.save(confirmed(hopeful, all_sets, percent).union(compared(many, all_sets, classes, percent)), "links3")
        if not found.isEmpty():
            labels = components(links.union(found), scratch, "components3")

    rep = classes.select("digest", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("found"))
    out = table.join(rep, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return scratch.only(scratch.save(out, "result"), before)


def dedup(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id; columns stay.

    Rows without doc_id stay.
    """
    gone = near_duplicates(docs, width, percent, scratch).where("kept = false").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")
