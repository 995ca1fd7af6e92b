"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Words are drawn in blocks. Each source's documents are put in a fixed random order (a hash of the id), which makes
the source one stream of words that is cut into blocks of ``block_words``. A permutation (an affine one, another for
each round) puts the blocks in the order in which they are drawn, round by round, ``most`` rounds at most; blocks are
drawn until the source's quota of words is full, the last one in part. How many of a source's drawn blocks each output
shard gets is settled by a binary tree over the shards: at each node the block counts of all sources are split
between the halves by one multivariate-hypergeometric draw, so every level keeps the quotas exactly. Shards take
consecutive, hence disjoint, runs of the permuted blocks, and each orders its pieces by a hash.

Rows that are equal in all columns are one row with a count until they have been placed, so that a third of all rows
under one id is no load on one task. The running sum that places a document in its source's stream has two levels,
sums of hash buckets and within a bucket, so that a source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0; a null source is a source of its own that sorts last; documents of size 0
are never taken (taken 0); rows repeated with one id, or with a null id, are rows of their own and each may be taken;
an empty table gives an empty result. The draw depends on the rows and the seed only, so reruns agree.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import columns_of, row_hash, small, stored, word_count

#: Weights of the sources in the order of their names, repeating; their share of all sizes; the most a source's size is multiplied by.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Documents in a hash bucket, about; words in a block; blocks in a shard, about; shards at most (larger inputs get larger shards).
BUCKET_ROWS = 20_000
BLOCK_WORDS = 4096
SHARD_BLOCKS = 64
SHARDS = 8192
#: Buckets of a source at least (if it has as many rows); equal rows that one task places at most.
BUCKETS = 64
EQUAL_ROWS = 10_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of the sources in their order: by weight, none above ``most`` times its size, the excess shared again by weight."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    open_, target, left = set(range(len(sizes))), [0.0] * len(sizes), share * sum(sizes)
    while open_:
        total = sum(weight[k] for k in open_)
        over = {k for k in open_ if left * weight[k] / total > most * sizes[k]}
        if not over:
            for k in open_:
                target[k] = left * weight[k] / total
            break
        for k in over:
            target[k] = most * sizes[k]
        left -= sum(target[k] for k in over)
        open_ -= over
    return target


def split_tree(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources). Column sums are the quotas, row sums differ by one at most."""
    out = np.zeros((shards, len(quota)), dtype=np.int64)
    if not quota:
        return out
    todo = [(0, shards, np.asarray(quota, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        ends = [int(quota_total * total_part // shards) for quota_total, total_part in ((sum(quota), lo), (sum(quota), mid))]
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, min(total, ends[1] - ends[0]), method="marginals")
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def permutation(blocks: int, seed: int, round_: int) -> tuple[int, int]:
    """a, c of the permutation b -> (a b + c) mod blocks."""
    rng = np.random.default_rng([seed, round_, blocks])
    a = int(rng.integers(1, blocks + 1))
    while math.gcd(a, blocks) != 1:
        a = a % blocks + 1
    return a, int(rng.integers(0, blocks))


def drawn_blocks(size: int, quota: int, block_words: int, order: list[tuple[int, int]]) -> int:
    """Number of blocks that fill the quota of words, the last one in part; all blocks have ``block_words`` words but for the last of the stream."""
    blocks = -(-size // block_words)
    if not quota:
        return 0
    rounds, rest = divmod(quota, size)
    if not rest:
        return rounds * blocks
    a, c = order[rounds]
    short = (a * (blocks - 1) + c) % blocks  # where the short block comes
    need = -(-rest // block_words)
    if need > short:  # it comes before the quota is full
        need = -(-(rest + blocks * block_words - size) // block_words)
    return rounds * blocks + max(need, 1)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, row_hash, n_equal, size, source_size, target, taken and ``pieces`` (shard, copy, words from, to, order) of every document.

    Sources are few (their names and sizes fit the driver; this is the table of weights); documents are not collected.
    """
    if share > most:
        raise ValueError("the share of all sizes cannot exceed the most of each")
    spark = documents.sparkSession
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), row_hash(documents).alias("row_hash"))
    classes = stored(sized.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("n_equal")), "mix-sizes")
    totals = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_equal")).alias("source_size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in totals]
    target = targets(sizes, weights, share, most)
    quota = [min(round(t), int(most * s)) for t, s in zip(target, sizes, strict=True)]
    rounds = -int(-most // 1)
    order = [[permutation(max(1, -(-s // block_words)), seed + k, r) for r in range(rounds + 1)] for k, s in enumerate(sizes)]
    blocks = [drawn_blocks(s, q, block_words, o) for s, q, o in zip(sizes, quota, order, strict=True)]
    shards = min(SHARDS, max(1, -(-sum(blocks) // shard_blocks)))
    ends = np.cumsum(split_tree(blocks, shards, seed), axis=0)
    plan = []
    for k, (r, s, t, q) in enumerate(zip(totals, sizes, target, quota, strict=True)):
        # where the search for a block's shard begins: of each of ``shards`` equal runs of drawn blocks the first shard
        stride = max(1, -(-blocks[k] // shards))
        starts = np.searchsorted(ends[:, k], np.arange(0, blocks[k] + 2 * stride, stride), side="right")
        buckets = max(min(BUCKETS, r["n"]), -(-r["n"] // bucket_rows))
        plan.append((r["source"], s, float(t), q, buckets, stride, np.minimum(starts, shards - 1).tolist(), ends[:, k].tolist(), [a for a, _ in order[k]], [c for _, c in order[k]]))
    schema = "source string, source_size long, target double, quota long, buckets int, stride long, starts array<int>, ends array<long>, a array<long>, c array<long>"
    sources = stored(spark.createDataFrame(plan, schema), "mix-sources")  # a row for each source
    narrow = sources.select("source", "source_size", "target", "quota", "buckets")

    rows = classes.withColumnRenamed("source", "of").join(F.broadcast(narrow), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    # the high bits of the hash order the buckets, the whole hash the documents in each
    rows = rows.withColumn("key", F.xxhash64("doc_id", "row_hash", F.lit(seed))).withColumn("bucket", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("int"))
    words = F.col("size") * F.col("n_equal")
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    before = stored(sums.select("source", "bucket", (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("before")), "mix-buckets")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum(words).over(inside)).withColumnsRenamed({"source": "of", "bucket": "b"})
    placed = placed.join(small(before), F.col("of").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket"))).drop("source", "b", "bucket", "buckets", "key")
    placed = placed.withColumn("first", F.col("before") + F.col("upto") - words).drop("before", "upto")
    # copies take their places one after another; large numbers of them are dealt out in parts
    many = placed.filter(F.col("n_equal") > EQUAL_ROWS).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_equal") - 1, F.lit(EQUAL_ROWS).cast("long"))))
    few = placed.filter(F.col("n_equal") <= EQUAL_ROWS).withColumn("part", F.lit(0).cast("long"))
    each = F.sequence(F.col("part"), F.least(F.col("part") + EQUAL_ROWS, F.col("n_equal")) - 1)
    placed = few.unionByName(many.repartition("row_hash", "part")).withColumn("copy_of", F.explode(each))
    placed = placed.withColumn("first", F.col("first") + F.col("copy_of") * F.col("size")).drop("part", "copy_of")

    lookup = sources.select("source", "stride", "starts", "ends", "a", "c")
    placed = placed.join(F.broadcast(lookup), F.col("of").eqNullSafe(F.col("source"))).drop("of", "source")
    last_block = F.floor((F.col("source_size") - 1) / block_words).cast("long")
    last_words = F.col("source_size") - last_block * block_words

    def piece(round_: int, block: Column) -> Column:
        a, c = F.get("a", F.lit(round_)), F.get("c", F.lit(round_))
        rank = (a * block + c) % (last_block + 1)
        short = (a * last_block + c) % (last_block + 1)
        drawn = F.lit(round_) * F.col("source_size") + rank * block_words - F.when(rank > short, block_words - last_words).otherwise(0)
        left = F.least(F.col("quota") - drawn, F.when(block == last_block, last_words).otherwise(block_words))  # words of the block that are drawn
        start = block * block_words
        lo = F.greatest(F.col("first"), start) - F.col("first")
        hi = F.least(F.col("first") + F.col("size"), start + left) - F.col("first")
        number = F.lit(round_) * (last_block + 1) + rank
        near = F.get("starts", F.floor(number / F.col("stride")).cast("int"))
        until = F.coalesce(F.get("starts", F.floor(number / F.col("stride")).cast("int") + 1), F.size("ends") - 1)
        shard = near + F.size(F.filter(F.slice("ends", near + 1, until - near + 1), lambda e: e <= number))
        order_ = F.xxhash64("doc_id", "row_hash", F.col("first"), block, F.lit(seed), F.lit(round_))
        return F.when(hi > lo, F.struct(shard.cast("int").alias("shard"), F.lit(round_).alias("copy"), lo.cast("long").alias("from"), hi.cast("long").alias("to"), order_.alias("order")))

    spanned = F.sequence(F.floor(F.col("first") / block_words).cast("long"), F.floor((F.col("first") + F.greatest(F.col("size") - 1, F.lit(0))) / block_words).cast("long"))
    found = F.concat(*[F.transform(spanned, partial(piece, r)) for r in range(rounds)])
    pieces = F.when(F.col("size") > 0, F.filter(found, lambda p: p.isNotNull())).otherwise(F.array().cast("array<struct<shard:int,copy:int,from:long,to:long,order:long>>"))
    out = placed.select("doc_id", "row_hash", "n_equal", "size", "source_size", "target", pieces.alias("pieces"))
    return out.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda t, p: t + p["to"] - p["from"]))


def draw(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row for each piece taken, with the columns of ``documents`` and mix_shard, mix_copy and mix_order: dealt to its shard and ordered there by hash.

    Pieces are words of the text, joined by single spaces where it is not taken whole; n_chars (if there is one) is that of the piece.
    Columns of ``documents`` that have the three names are replaced. Copies of one row are read once and dealt to as many tasks as they need.
    """
    own = ("mix_shard", "mix_copy", "mix_order")
    kept = [c for c, f in zip(columns_of(documents), documents.columns, strict=True) if f not in own]
    picks = mixed.filter(F.col("taken") > 0).select(F.col("doc_id").alias("id"), "row_hash", "n_equal", "size", F.explode("pieces").alias("piece"))
    parts = F.least(F.lit(64), F.ceil(F.col("n_equal") / EQUAL_ROWS)).cast("int")
    picks = picks.withColumn("salt", F.pmod(F.col("piece.order"), parts).cast("int"))
    rows = documents.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("doc"), row_hash(documents).alias("hash"))
    repeated = mixed.filter(F.col("n_equal") > 1).groupBy(F.col("doc_id").alias("r_id"), F.col("row_hash").alias("r_hash")).agg(F.max(parts).alias("parts"))
    repeated = small(stored(repeated, "mix-repeated"))
    same = F.col("doc").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash"))
    once = rows.join(repeated, same, "left_anti").withColumn("part", F.lit(0))
    copies = rows.join(repeated, same).groupBy("doc", "hash").agg(F.first("row").alias("row"), F.max("parts").alias("parts"))
    copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = once.unionByName(copies).join(picks, (F.col("hash") == F.col("row_hash")) & (F.col("part") == F.col("salt")) & F.col("doc").eqNullSafe(F.col("id")))
    part = F.col("piece.to") - F.col("piece.from") < F.col("size")
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(part, F.array_join(F.slice(words, F.col("piece.from").cast("int") + 1, (F.col("piece.to") - F.col("piece.from")).cast("int")), " ")).otherwise(F.col("row.text"))
    found = found.withColumn("text", text)
    cols = []
    for f in documents.schema.fields:
        if f.name not in own:
            value = F.col("row").getField(f.name)
            if f.name == "text":
                value = F.col("text")
            elif f.name == "n_chars":
                value = F.when(part, F.length("text").cast(f.dataType)).otherwise(value)
            cols.append(value.alias(f.name))
    out = found.select(*cols, F.col("piece.shard").alias("mix_shard"), F.col("piece.copy").alias("mix_copy"), F.col("piece.order").alias("mix_order"))
    return out.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")


def digest(mixed: DataFrame) -> DataFrame:
    """The result columns of the query; ``shards`` lists the shards that a document's copies went to."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"]))).alias("shards"))
