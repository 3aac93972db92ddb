"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A source whose target is r times its size
takes each document floor(r) times for certain; the rest of the target is a
sample without replacement in which document i has the inclusion probability

    p(i) = min(1, c * w(i))

with weights w and c such that the expected words are the rest. Documents with
p = 1 are taken for certain as well. Pareto sampling ranks the others by

    Q(i) = (U(i) / (1 - U(i))) / (p(i) / (1 - p(i)))

with U(i) uniform, and takes them in ascending order until the rest is filled.

No source is ever sorted as a whole: a histogram of Q finds the bin in which the
rest runs out, a second one the part of that bin, and only the documents of that
part are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.llm.shared import Scratch, free_name, word_count

#: Bins of each of the two rank histograms of a source.
BINS = 4096
#: Weights are whole numbers from 1 to this one, so that their sums are exact and a source has few of them.
MOST_WEIGHT = 1 << 16
#: Sources up to which their targets are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone; 52 bits of an MD5 digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def text_tag() -> Column:
    return F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 16)


def targets(sizes: list[tuple[str | None, int]], most: float = 3.0) -> dict[str | None, float]:
    """Target words of each source, of (source, words).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words.
    A target stops at ``most`` times its source's words; what is over goes to
    the others by weight, until none is above. One number per source.
    """
    names = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s, _ in sizes if s is None]
    size, weight = dict(sizes), {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(weight[s] for s in open_)
        found = {s: rest * weight[s] / share for s in open_}
        over = [s for s in open_ if found[s] > most * size[s]]
        if not over:
            return fixed | found
        fixed |= {s: most * size[s] for s in over}


def calibrated(known: DataFrame) -> DataFrame:
    """Adds ``chance``, the inclusion probability, to rows (source, size, rest, weight) with one rest per source.

    Words are summed by weight, with partial aggregation. From the heaviest on,
    documents are certain until c * w is at most 1 for all others.
    """
    # Rows without words change nothing; their chance is 0.
    takes = (F.col("size") > 0) & (F.col("rest") > 0)
    sums = known.where(takes).groupBy("source", "weight").agg(F.sum("size").alias("words"), F.sum((F.col("weight") * F.col("size")).cast("decimal(38,0)")).alias("mass"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy(F.col("weight").desc())
    heavier, lighter = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    factor = (F.col("rest") - F.coalesce(F.sum("words").over(heavier), F.lit(0))) / F.sum("mass").over(lighter).cast("double")
    # The heaviest weight for which c * w is at most 1; without one, all are certain.
    fits = sums.withColumn("factor", factor).where(F.col("factor") * F.col("weight") <= 1).groupBy("source").agg(F.max(F.struct("weight", "factor")).alias("f"))
    fits = fits.select(F.col("source").alias("f_source"), F.col("f.weight").alias("f_weight"), F.col("f.factor").alias("f_factor"))
    joined = known.join(fits, F.col("source").eqNullSafe(F.col("f_source")), "left")
    bounded = F.least(F.greatest(F.col("f_factor") * F.col("weight"), F.lit(0.0)), F.lit(1.0))
    chance = F.when(~takes, F.lit(0.0)).when(F.col("f_weight").isNull() | (F.col("weight") > F.col("f_weight")), F.lit(1.0)).otherwise(bounded)
    return joined.withColumn("chance", chance).drop("f_source", "f_weight", "f_factor")


def edges(drawn: DataFrame, bin_: str, before: str | None = None) -> DataFrame:
    """Adds to rows (source, size, rest) with a bin the words before and through it: words_before, words_through. ``before`` are words before all bins."""
    start = F.col(before) if before else F.lit(0)
    sums = drawn.groupBy("source", bin_, *([before] if before else [])).agg(F.sum("size").alias("words"))
    so_far = start + F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("b_source"), F.col(bin_).alias("b_bin"), so_far.alias("words_before"), (so_far + F.col("words")).alias("words_through"))
    return drawn.join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col(bin_) == F.col("b_bin"))).drop("b_source", "b_bin")


def length_weight(size: Column) -> Column:
    """Inclusion weights of the queries: documents count by the logarithm of their words."""
    return F.round(F.log(F.lit(1.0) + size) * 64)


def mix(docs: DataFrame, seed: int = 0, most: float = 3.0, scratch: Scratch | None = None, weight: Callable[[Column], Column] = length_weight) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, tag (a hash of the text), size, source_size, target,
    chance, copies, taken (copies * size). ``weight`` gives the relative
    inclusion weight of a row by its size, a whole number up to ``MOST_WEIGHT``. The sample of a source ends with the
    document that brings it nearest to its target, so it misses by half a
    document at most.

    A null text and a text without words have size 0 and are taken as often as
    is certain for their source, which adds nothing. A null source is a source.
    Rows that share doc_id and text share their rank and are taken one by one;
    rows with one doc_id, or none, and different texts have ranks of their own.
    A source without words has target 0 and copies 0. An empty table gives no
    rows. The same input gives the same mix.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_tag().alias("tag"), word_count(F.col("text")).alias("size"))
    sized = scratch.save(columns, "sizes")
    per_source = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    if not per_source:
        return sized.select("doc_id", "source", "tag", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0.0).alias("chance"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    goal = targets(per_source, most)
    # Per source: its size and target, how often all its documents are taken, and the words that are left to draw.
    plan = [(s, n, float(goal[s]), math.floor(goal[s] / n) if n else 0) for s, n in per_source]
    table = spark.createDataFrame([(s, n, t, c, t - c * n) for s, n, t, c in plan], "source string, source_size long, target double, certain long, rest double")
    table = F.broadcast(table) if len(per_source) <= MOST_BROADCAST else table
    known = sized.join(table, sized.source.eqNullSafe(table.source), "left").drop(table.source).withColumn("weight", F.least(F.greatest(weight(F.col("size")).cast("long"), F.lit(1)), F.lit(MOST_WEIGHT)))
    u, p = uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tag")), seed), F.col("chance")
    rank = F.when(p > 0, F.when(p < 1, (u / (1 - u)) / (p / (1 - p))).otherwise(F.lit(0.0)))
    # Those that are certain come before all bins.
    level = F.col("q") / (1 + F.col("q")) * BINS
    ranked = calibrated(known).withColumn("q", rank).withColumn("bin", F.when(p >= 1, F.lit(-1)).otherwise(F.least(F.floor(level), F.lit(BINS - 1))).cast("int"))
    ranked = scratch.save(ranked.drop("weight"), "ranked")
    drawn, never = ranked.where("q is not null"), ranked.where("q is null")
    edge = (F.col("words_before") < F.col("rest")) & (F.col("words_through") > F.col("rest"))
    rule = lambda rows: rows.where(~edge).withColumn("extra", (F.col("words_through") <= F.col("rest")).cast("long"))
    placed = edges(drawn, "bin")
    first = placed.where(edge).withColumnRenamed("words_before", "bin_before").drop("words_through").withColumn("part", F.least(F.floor((level - F.col("bin")) * BINS), F.lit(BINS - 1)).cast("int"))
    fine = edges(first, "part", "bin_before")
    inside = W.partitionBy("source", "part").orderBy("q", "doc_id", "tag", "size")
    through = F.col("words_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
    cut = fine.where(edge).withColumn("through", through).withColumn("extra", (F.col("through") - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    kept = ["doc_id", "source", "tag", "size", "source_size", "target", "chance", "certain", "extra"]
    parts = [rule(placed), rule(fine), cut, never.withColumn("extra", F.lit(0).cast("long"))]
    taken = parts[0].select(*kept)
    for more in parts[1:]:
        taken = taken.unionByName(more.select(*kept))
    taken = taken.withColumn("copies", F.col("certain") + F.col("extra"))
    return taken.select("doc_id", "source", "tag", "size", "source_size", "target", "chance", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0, most: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all its columns.

    A document whose copies are 0 is left out, as is every document without
    words. Rows that share doc_id, source and text are alike to the mix: as many
    are taken as it takes of them, spread evenly.
    """
    id_, source, tag, total, rows, copies = (free_name(docs, x) for x in ("mix_id", "mix_source", "mix_tag", "mix_total", "mix_rows", "mix_copies"))
    taken = mix(docs, seed, most, scratch).where("size > 0")
    counts = taken.groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("tag").alias(tag)).agg(F.sum("copies").alias(total), F.count("*").alias(rows)).where(F.col(total) > 0)
    joined = docs.join(counts.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (text_tag() == F.col(tag)))
    alone = joined.where(F.col(rows) == 1).withColumn(copies, F.col(total))
    place = F.row_number().over(W.partitionBy(id_, source, tag).orderBy(F.lit(0)))
    several = joined.where(F.col(rows) > 1).withColumn(copies, F.floor(F.col(total) / F.col(rows)) + (place <= F.col(total) % F.col(rows)).cast("long"))
    chosen = alone.unionByName(several).where(F.col(copies) > 0)
    return chosen.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
