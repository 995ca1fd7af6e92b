"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints have 64 bits; two documents are linked when theirs differ in at most ``radius`` bits. The bits are
grouped into partitions, correlated bits together; each partition gets its own threshold, their sum being
radius - partitions + 1, so that every linked pair agrees within the threshold in one partition at least. Thresholds
(unequal, -1 meaning an unused partition) and the number of partitions minimise, by dynamic programming, the probes
plus the candidates estimated from counts over all distinct fingerprints. Every fingerprint is filed under its own
key and under the keys within its partition's threshold; documents that share a key are candidates and are verified
with the whole fingerprints.

Equal fingerprints are one node, whatever the number and the ids of their documents. A key's fingerprints are not
paired: a search that removes what it has reached links each to the smallest of its connected set, so a key yields
fewer links than members. The members of a key with more than ``block`` are dealt once more, by radius + 1 groups of
the bits outside the key, of which linked ones agree in one; what is then still larger is cut into blocks, and each
pair of blocks is a task's work. Components come from star contraction with tables in the shared folder between
rounds; its joins are of narrow rows, which adaptive execution splits where one node has many links.

Defined results: null and empty texts, and texts without a word, have fingerprint 0 and are linked like any other;
rows repeated with one id each get a row and count as one document (what links to any of their texts is linked);
documents with a null id are linked like any other, but are not a component's name (the component is null if it holds
no other id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import columns_of, row_hash, small, spread_join, stored, text_batches, words_of

BITS = 64
SHINGLE = 4
RADIUS = 4
#: Fingerprints of a key that one task compares with each other; cost of a probe in candidates.
BLOCK = 4096
PROBE_COST = 300.0


def hashes(words: list[bytes], size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles (fewer words: of the whole sequence)."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()[min(size, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)


def fingerprint(text: str) -> int:
    """The SimHash of a text as an unsigned 64-bit number: a bit is set if it is in over half of the hashes."""
    h = hashes(words_of(text))
    if not len(h):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, row_hash (of all columns) and fingerprint (as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in text_batches(batches):
            found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), pa.array(rest["row_hash"], pa.int64()), pa.array(found)], ["doc_id", "row_hash", "fingerprint"])

    rows = documents.select(F.col("doc_id").cast("long"), row_hash(documents).alias("row_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, row_hash long, fingerprint long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for every pair of bits how many have both set (the diagonal: each bit). A matrix of fixed size reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(x), 65536):
                bits = np.unpackbits(x[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BITS * BITS), -1)), pa.array(np.append(both.reshape(-1), n).astype(np.int64))], ["k", "n"])

    got = dict(distinct.select("fingerprint").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size: each is grown from the first free bit by the bit most correlated with the group."""
    p = np.diag(both) / max(n, 1)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(scale, scale))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int = RADIUS) -> tuple[list[int], float]:
    """Thresholds of the groups, of sum radius - groups + 1, that minimise probes plus estimated candidates; and that cost."""
    n = max(n, 1)  # of nothing, the plan with the fewest probes
    p = np.diag(both) / n
    costs = []
    for g in groups:
        differ = np.zeros(len(g) + 1)  # distribution of the bits in which two fingerprints differ
        differ[0] = 1
        for b in g:
            q = 2 * p[b] * (1 - p[b])
            differ = differ * (1 - q) + np.append(0, differ[:-1]) * q
        # two fingerprints that differ in d of the group's bits share this many keys
        def shared(d: int, r: int, w: int = len(g)) -> int:
            return sum(math.comb(d, i) * math.comb(w - d, j) for i in range(d + 1) for j in range(w - d + 1) if i + j <= r and d - i + j <= r)

        cost = [0.0]
        for t in range(radius + 1):
            r = -(-t // 2)
            keys = n * PROBE_COST * sum(math.comb(len(g), k) for k in range(r + 1))
            cost.append(keys + 0.5 * n * n * sum(differ[d] * shared(d, r) for d in range(min(2 * r, len(g)) + 1)))
        costs.append(cost)
    want = radius - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:  # best[s]: the cheapest thresholds of the groups so far whose sum is s
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, t) in best.items():
            for threshold, more in enumerate(cost, -1):
                if c + more < step.get(s + threshold, (math.inf, []))[0]:
                    step[s + threshold] = (c + more, [*t, threshold])
        best = step
    return best[want][1], best[want][0]


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The used groups of bits with their thresholds, over the cheapest number of groups."""
    found = []
    for parts in range(1, radius + 2):
        groups = group_bits(n, both, parts)
        thresholds, cost = allocate(n, both, groups, radius)
        found.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(found)[2]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def probes(groups: list[tuple[list[int], int]]) -> list[tuple[int, int, int]]:
    """(group, mask of its bits, flips) for every key that a fingerprint is filed under.

    Both of a pair are filed within half the threshold, rounded up: two keys within the threshold have one in common.
    """
    out = []
    for k, (bits, threshold) in enumerate(groups):
        mask = sum(1 << b for b in bits)
        balls = [0]
        for _ in range(-(-threshold // 2)):
            balls = sorted({f ^ (1 << b) for f in balls for b in bits} | set(balls))
        out += [(k, _signed(mask), _signed(f)) for f in balls]
    return out


def stars(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links (smallest node, node) of the connected sets of distinct fingerprints within ``radius``.

    What has been reached leaves the search, so a set of near copies costs about its size.
    """
    a: list[int] = []
    b: list[int] = []
    order = np.argsort(node, kind="stable")
    fp, node = fp[order], node[order]
    if len(fp) <= 64:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        if int(near.sum()) == len(fp):
            return a, b
    while len(fp) > 1:
        root, frontier, fp, node = node[0], [fp[0]], fp[1:], node[1:]
        while frontier and len(fp):
            near = np.bitwise_count(fp ^ frontier.pop()) <= radius
            if near.any():
                frontier.extend(fp[near])
                b += node[near].tolist()
                a += [int(root)] * int(near.sum())
                fp, node = fp[~near], node[~near]
    return a, b


def links(distinct: DataFrame, groups: list[tuple[list[int], int]], radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a < b) between nodes whose components are those of all pairs within ``radius``. distinct: fingerprint, node."""
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.lit(flip).cast("long")).alias("key")) for k, mask, flip in probes(groups)])
    none = F.lit(0).cast("long")
    filed = distinct.select("fingerprint", "node", F.explode(keys).alias("k")).select("k.part", "k.key", F.lit(-1).alias("sub"), none.alias("rest"), "fingerprint", "node")
    large = _large(filed, block)
    dealt = filed.withColumn("pair", none)
    if large is not None:  # deal the members of large keys once more, by bits outside the key
        own = ["part", "key", "sub", "rest"]
        subs = [F.array(*[F.struct(F.lit(j).alias("sub"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("rest")) for j, m in enumerate(rest_masks(bits, radius))]) for bits, _ in groups]
        chosen = F.coalesce(*[F.when(F.col("part") == k, x) for k, x in enumerate(subs)])
        hot = filed.join(small(large), own, "left_semi").drop("sub", "rest").withColumn("s", F.explode(chosen)).select("part", "key", "s.sub", "s.rest", "fingerprint", "node")
        again = _large(hot, block)
        dealt = filed.join(small(large), own, "left_anti").withColumn("pair", none)
        if again is None:
            dealt = dealt.unionByName(hot.withColumn("pair", none))
        else:  # a row goes to the task of every pair of blocks that has its own
            dealt = dealt.unionByName(hot.join(small(again), own, "left_anti").withColumn("pair", none))
            mine = F.pmod(F.xxhash64("fingerprint", F.lit(7)), F.col("blocks"))
            pairs = F.transform(F.sequence(none, F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
            cut = hot.join(small(again), own).withColumn("mine", mine).withColumn("pair", F.explode(pairs))
            dealt = dealt.unionByName(cut.select(*own, "fingerprint", "node", "pair"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key_cols: list[np.ndarray], fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in key_cols], axis=0)) + 1
            bounds = np.concatenate(([0], change, [len(fp)]))
            a: list[int] = []
            b: list[int] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                x, y = stars(fp[bounds[k] : bounds[k + 1]], node[bounds[k] : bounds[k + 1]], radius)
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = np.all([c == c[-1] for c in cols[:5]], axis=0)
            cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0  # the last key may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield from out([c[:cut] for c in cols[:5]], cols[5][:cut].view(np.uint64), cols[6][:cut])
        if held is not None and len(held[0]):
            yield from out(held[:5], held[5].view(np.uint64), held[6])

    place = ["part", "key", "sub", "rest", "pair"]
    return dealt.select(*place, "fingerprint", "node").repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long").distinct()


def rest_masks(bits: list[int], radius: int) -> list[int]:
    """The bits outside a key's, dealt to radius + 1 masks: fingerprints within the radius agree under one of them."""
    rest = [b for b in range(BITS) if b not in bits]
    return [_signed(sum(1 << b for b in rest[k :: radius + 1])) for k in range(radius + 1)]


def _large(filed: DataFrame, block: int) -> DataFrame | None:
    """Keys of more than ``block`` members, with the number of blocks they make; None without any."""
    own = ["part", "key", "sub", "rest"]
    sizes = filed.groupBy(*own).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    found = stored(sizes.select(*own, F.ceil(F.col("n") / block).cast("long").alias("blocks")), "simhash-large")
    return None if found.isEmpty() else found


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node with a link, by alternating large and small stars."""
    edges = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours that are larger than a node move to the smallest of its neighbourhood
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what is smaller than a node is linked to the smallest of it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(lower.filter(F.col("u") != F.col("v")).distinct(), "links")
        # done when every node has one link and no link's end has a link of its own
        roots = after.select(F.col("v").alias("u")).distinct()
        open_ = after.groupBy("u").agg(F.count("*").alias("n")).join(roots.withColumn("root", F.lit(True)), "u", "left").filter((F.col("n") > 1) | F.col("root")).limit(1).count()
        edges = after
        if not open_:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _linked(documents: DataFrame, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: doc_id, row_hash, fingerprint of every row; fingerprint, component of those with a link."""
    found = stored(fingerprints(documents), "fingerprints")
    nodes = stored(found.groupBy("fingerprint").agg(F.col("fingerprint").alias("node")).select("fingerprint", "node"), "nodes")
    n, both = bit_counts(nodes)
    groups = plan(n, both, radius)
    # the fingerprints of rows repeated with one id are linked through it
    of_doc = found.filter(F.col("doc_id").isNotNull())
    several = stored(of_doc.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("most")).filter("a <> most").select("doc_id", "a"), "repeated-ids")
    same_id = spread_join(of_doc, several, "doc_id", "inner").select("a", F.col("fingerprint").alias("b")).distinct()
    linked = components(links(nodes, groups, radius, block).union(same_id))
    return found, linked.select(F.col("node").alias("fingerprint"), "component")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of every row of ``documents``."""
    found, linked = _linked(documents, radius, block)
    ids = found.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = ids.join(linked, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fingerprint", "component_id")
    return found.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One row of each component, that of the smallest id (of several with that id, or with none at all, that of the smallest hash); all columns as they are."""
    found, linked = _linked(documents, radius, block)
    of = found.join(linked, "fingerprint", "left").select(F.struct("doc_id", "row_hash").alias("key"), F.coalesce("component", "fingerprint").alias("component"))
    of = stored(of, "components")
    # rows alone in their component are none of the following tables
    first = F.min(F.struct(F.col("key.doc_id").isNull().alias("last"), F.col("key").alias("key")))["key"].alias("first")
    several = stored(of.groupBy("component").agg(first, F.count("*").alias("n")).filter("n > 1").select("component", "first"), "several")
    gone = stored(spread_join(of, several, "component", "inner").filter(F.col("key") != F.col("first")).select("key").distinct(), "duplicates")
    again = stored(spread_join(of, several, "component", "inner").filter(F.col("key") == F.col("first")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "equal-rows")
    rows = documents.select(F.struct(*columns_of(documents)).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_hash(documents).alias("row_hash")).alias("key"))
    left = spread_join(rows, gone, "key", "left_anti")
    once = spread_join(left, again, "key", "left_anti").select("row.*")
    return once.unionByName(spread_join(left, again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*"))


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
