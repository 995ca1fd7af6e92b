"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into tokens (runs of letters and digits). A seed is the hash of the tokens at the fixed
offsets of a mask, which ignores the positions between them, so that a hit survives substitutions there. Seeds of all
training positions are joined with those of the benchmark. A hit fixes a diagonal (position in the document less
position in the item); along it the document is compared with the item token by token, and the pair is reported if
some window of ``window`` tokens (of the whole item where it is shorter) agrees in ``least`` of its positions.

Masks are chosen for each number of tokens compared (``window``, or the item's length where that is less), so that
whatever tokens of an accepted window differ, some mask at some shift lies on equal ones: every pair that the rule
accepts is found. Items of under five tokens agree whole or not at all; only the first place of such an item in a
text is looked at.

Texts are examined by their content, so that rows with no id or with another row's id are judged like all others.

Defined results: null and empty texts (of either table), and texts without a letter or digit, match nothing; rows
repeated with one id count once, with the best of their matches, as do all rows with a null id; items of equal text
are all reported, items without an id are not; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import columns_of, small, spread_join, stored

#: Masks by (tokens compared, tokens that may differ); each set hits every choice of differing tokens, as a test enumerates.
COVERS = {
    (13, 2): ((0, 1, 2, 4, 6, 7), (0, 1, 3, 7, 8, 9)),
    (12, 2): ((0, 1, 2, 4, 6, 7), (0, 1, 3, 7, 8, 9), (0, 2, 5, 6, 7, 8)),
    (11, 2): ((0, 1, 2, 3, 5, 6), (0, 1, 5, 6, 7, 8), (0, 1, 3, 4, 8, 9)),
    (10, 2): ((0, 1, 3, 4, 5), (0, 1, 2, 6, 8), (0, 2, 3, 5, 6)),
    (9, 1): ((0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 7, 8)),
    (8, 1): ((0, 1, 3, 4, 5), (0, 2, 3, 4, 7)),
    (7, 1): ((0, 1, 2, 3, 5), (0, 1, 3, 4, 5), (0, 2, 4, 5, 6)),
    (6, 1): ((0, 1, 3, 4), (0, 2, 3, 5)),
    (5, 1): ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4)),
}
WINDOW = 13
LEAST = 0.8
#: Items under this length take no substitution; ``clean`` takes them for evidence of nothing ("yes" is in many a text).
SHORT = 5


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, an array of longs."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(t: Column, mask: tuple[int, ...], number: int) -> Column:
    """The seed of every position at which the mask fits, an array of longs."""
    last = F.size(t) - (mask[-1] + 1)
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(number), *[F.get(t, i + o) for o in mask]))


def cover(n: int, least: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one hits any ``n`` tokens that agree in ``least`` of them: those of COVERS, or n cut into one block more than tokens may differ."""
    differ = min(n - 1, n - math.ceil(n * least))
    cuts = [n * k // (differ + 1) for k in range(differ + 2)]
    return COVERS.get((n, differ)) or tuple(tuple(range(z - a)) for z, a in sorted({(z, a) for a, z in zip(cuts, cuts[1:], strict=False)}))


def _all_seeds(rows: DataFrame, key: str, masks: list[tuple[int, int, tuple[int, ...]]], window: int | None = None) -> DataFrame:
    """key, pos, seed over all masks (number, tokens compared, offsets); with ``window`` each row has the masks of its own length only."""
    out = None
    for number, n, mask in masks:
        of = rows if window is None else rows.filter(F.least(F.size("t"), F.lit(window)) == n)
        one = of.select(key, F.posexplode(seeds(F.col("t"), mask, number)).alias("pos", "seed"))
        out = one if out is None else out.union(one)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, min_tokens: int = 1) -> DataFrame:
    """doc_id, item_id, n_same, n_compared, position: the best window of every contaminated pair."""
    pairs = stored(text_pairs(documents, benchmark, window, least, min_tokens), "text-pairs")
    rows = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), _digest())
    # a text may hold several items
    found = spread_join(rows, pairs.groupBy("digest").agg(F.collect_list(F.struct("item_id", "best")).alias("held")), "digest", "inner")
    best = found.select("doc_id", F.explode("held").alias("h")).groupBy("doc_id", "h.item_id").agg(F.max("h.best").alias("best"))
    return best.select("doc_id", "item_id", "best.n_same", "best.n_compared", (-F.col("best.negative")).alias("position"))


def _digest() -> Column:
    return F.unhex(F.md5("text")).alias("digest")


def text_pairs(documents: DataFrame, benchmark: DataFrame, window: int, least: float, min_tokens: int) -> DataFrame:
    """digest (of a contaminated text), item_id, best (window) of every pair of different texts and items."""
    items = stored(benchmark.select("item_id", tokens(F.col("text")).alias("t")).filter(F.size("t") >= min_tokens), "items")
    lengths = sorted(r[0] for r in items.select(F.least(F.size("t"), F.lit(window))).distinct().collect())  # at most ``window`` of them
    masks = [(k, n, mask) for k, (n, mask) in enumerate((n, mask) for n in lengths or [window] for mask in cover(n, least))]
    texts = items.groupBy("t").agg(F.min("item_id").alias("item")).filter(F.col("item").isNotNull())  # items of equal text are one
    known = stored(_all_seeds(texts.select("item", "t"), "item", masks, window).join(texts.select("item", (F.size("t") < SHORT).alias("short")), "item").select("seed", "item", F.col("pos").alias("item_pos"), "short"), "seeds")

    docs = documents.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("doc"), "text", tokens(F.col("text")).alias("t"))
    # first what can match at all: one row for each seed, so a passage in many items multiplies nothing here
    distinct = small(stored(known.select("seed").distinct(), "seed-keys"))
    hits = stored(_all_seeds(docs.select("doc", "t"), "doc", masks).join(distinct, "seed", "left_semi"), "hits")
    met = spread_join(hits, known, "seed", "inner").select("doc", "item", "short", (F.col("pos") - F.col("item_pos")).alias("shift"))
    diagonals = met.filter(~F.col("short")).select("doc", "item", "shift").distinct()
    diagonals = diagonals.union(met.filter("short").groupBy("doc", "item").agg(F.min("shift").alias("shift")))

    # then the tokens of documents with hits, next to those of the items
    found = stored(diagonals.groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts")), "diagonals")
    having = small(stored(found.select("doc").distinct(), "hit-docs"))
    # copies of a text are compared once
    sides = docs.join(having, "doc", "left_semi").groupBy("doc", _digest()).agg(F.any_value("t").alias("doc_t"))
    sides = sides.join(small(found), "doc").join(small(texts.withColumnRenamed("t", "item_t"), 20_000), "item")
    best = F.array_max(F.transform("shifts", lambda s: _best_window(F.col("doc_t"), F.col("item_t"), s, window)))
    judged = sides.select("digest", "item", best.alias("best")).filter(F.col("best.n_same") >= F.ceil(F.col("best.n_compared") * F.lit(least)))
    same = items.join(texts, "t").select("item", "item_id")
    return judged.join(small(same), "item").filter(F.col("item_id").isNotNull()).select("digest", "item_id", "best")


def _best_window(doc: Column, item: Column, shift: Column, window: int) -> Column:
    """The window along a diagonal with the most equal tokens: struct n_same, n_compared, negative (of its start in the document)."""
    n = F.least(F.lit(window), F.size(item))
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(doc) - shift)  # item positions first..last-1 have a partner
    equal = F.transform(F.sequence(first, F.greatest(last - 1, first)), lambda k: F.when(F.get(doc, k + shift) == F.get(item, k), 1).otherwise(0))
    starts = F.when(last - first >= n, F.sequence(F.lit(0), F.greatest(last - first - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.transform(starts, lambda a: F.struct(F.aggregate(F.slice(equal, a + 1, n), F.lit(0), lambda x, y: x + y).alias("n_same"), n.alias("n_compared"), (-(a + first + shift)).alias("negative"))))


def clean(documents: DataFrame, benchmark: DataFrame, min_tokens: int = SHORT) -> DataFrame:
    """``documents`` without the contaminated ones, whatever their ids; items of under ``min_tokens`` tokens remove nothing."""
    dirty = stored(text_pairs(documents, benchmark, WINDOW, LEAST, min_tokens).select("digest").distinct(), "contaminated")
    rows = documents.select(F.struct(*columns_of(documents)).alias("row"), F.unhex(F.md5("text")).alias("digest"))
    return spread_join(rows, dirty, "digest", "left_anti").select("row.*")
