"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, and every segment has its index. If two
codes differ in at most s * (r + 1) - 1 of their bits, s being the number of
segments, then at least one segment differs in r bits or fewer. So a query looks
up all segment values within radius 0, then 1, 2, ..., verifies the full
distance of what it meets, and stops once its k-th verified distance is at most
s * (r + 1) - 1: nothing closer can be left.

Equal codes are searched once, and only their k smallest ids are kept as
members, so a code that many rows share costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklog.llm.shared import Scratch

SEGMENT = 16
PER_WORD = 64 // SEGMENT


def sign_words(vector: Column, words: int) -> list[Column]:
    """The signs of a vector's numbers as words of 64 bits: bit i of word w is 1 where number 64 w + i is above 0."""
    out = []
    for w in range(words):
        part = F.transform(F.slice(vector, 64 * w + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        out.append(F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias(f"w{w}"))
    return out


def topk(vectors: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scratch: Scratch | None = None) -> DataFrame:
    """The k nearest rows of each row for which ``query`` holds, itself included.

    Returns query_id, rank (from 1), vec_id, distance: Hamming distances of sign
    codes, ties in order of id. Rows with a null vector are neither found nor
    asked. A null, NaN, zero or missing number gives bit 0 (NaN counts as above
    every number in Spark, so it gives bit 1). An empty vector is a code of
    zeros. Repeated rows are rows of their own, also as queries: a query id that
    comes twice has its list twice. With fewer than k rows every row is listed.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    known = vectors.where(F.col(vector_col).isNotNull())
    dims = known.agg(F.max(F.size(vector_col))).collect()[0][0] or 1
    n_words = -(-dims // 64)
    n_segments = n_words * PER_WORD
    names = [f"w{i}" for i in range(n_words)]
    coded = scratch.save(known.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("asks"), *sign_words(F.col(vector_col), n_words)), "codes")

    reps = scratch.save(coded.groupBy(*names).agg(F.min("id").alias("rep"), F.max("asks").alias("asks")), "reps")
    ranked = coded.withColumn("place", F.row_number().over(W.partitionBy(*names).orderBy("id"))).where(F.col("place") <= k)
    members = ranked.join(reps.select(*names, "rep"), names).select("rep", F.col("id").alias("member"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    segments = lambda: F.posexplode(F.array(*[F.shiftrightunsigned(F.col(w), SEGMENT * i).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int") for w in names for i in range(PER_WORD)]))
    index = scratch.save(reps.join(sizes, "rep").select(F.col("rep").alias("found"), "size", *[F.col(w).alias(f"f_{w}") for w in names], segments().alias("segment", "value")), "index")
    total = reps.count()

    asking = reps.where("asks").select(F.col("rep").alias("q"), *names)
    active, met, done = asking, None, []
    distance = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"f_{w}"))) for w in names), F.lit(0))
    best = W.partitionBy("q").orderBy("distance", "found")
    for radius in range(SEGMENT + 1):
        # One constant, which the optimizer folds.
        flips = F.split(F.lit(",".join(str(x) for x in range(1 << SEGMENT) if x.bit_count() == radius)), ",").cast("array<int>")
        probes = active.select("q", *names, segments().alias("segment", "own")).select("q", *names, "segment", F.explode(flips).alias("flip"), "own").withColumn("value", F.col("own").bitwiseXOR(F.col("flip")))
        # Spark's estimate doesn't know how many rows a query's flips become, so it must not choose to broadcast them.
        hits = probes.join(index.hint("merge"), ["segment", "value"]).select("q", "found", "size", distance.alias("distance"))
        pool = (hits if met is None else hits.unionByName(met.drop("reached"))).groupBy("q", "found", "size").agg(F.min("distance").alias("distance"))
        # k codes suffice: each has a member that comes before all members of later ones.
        top = pool.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
        met = scratch.save(top.withColumn("reached", F.sum("size").over(best)), f"met{radius}")
        seen = met.groupBy("q").agg(F.count("*").alias("codes"), F.min(F.when(F.col("reached") >= k, F.col("distance"))).alias("kth"))
        covered = n_segments * (radius + 1) - 1
        over = seen.where((F.col("kth") <= covered) | (F.col("codes") >= total))
        done.append(met.join(over.select("q"), "q", "left_semi").drop("reached"))
        active = scratch.save(active.join(over.select("q"), "q", "left_anti"), f"active{radius}")
        met = met.join(active.select("q"), "q", "left_semi")
        if radius == SEGMENT or active.isEmpty():
            break
    if not active.isEmpty():
        done.append(met.drop("reached"))
    near = done[0]
    for more in done[1:]:
        near = near.unionByName(more)
    per_code = near.join(members, near.found == members.rep).select("q", "distance", "member")
    order = W.partitionBy("q").orderBy("distance", "member")
    lists = per_code.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    askers = coded.where("asks").join(reps.select(*names, "rep"), names).select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    return askers.join(lists, "q").select("query_id", F.col("rank").cast("long").alias("rank"), F.col("member").alias("vec_id"), F.col("distance").cast("long").alias("distance"))
