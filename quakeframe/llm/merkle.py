"""Merkle manifest of a dataset: a ternary hash tree over each source's documents, and one over the sources' roots.

A leaf hashes the fields of a row. Parents are stored as preimages, the child hashes one after another: a leaf finds the
preimages above it, takes its own 64 characters out of each (what is left are its siblings), and folds to the root by
putting another hash into that slot. Trees are cut into blocks of ``BLOCK`` nodes, a row each with all preimages of six
levels, so that leaves are shuffled by (tree, block) once, however tall a tree is; the levels over a block are found
once for the block.

Defined results: null fields are hashed as ``-``, empty ones as ``0:``. A null source is a source of its own, before all
others. Within a source null ids come first and rows of one id go by their leaf; rows that are equal in all fields have
equal leaves, and their proofs are those of their places. A row without an id is never tampered with. An empty table
gives no row. Further columns are neither hashed nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import ranked, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS, HEX = 3, 6, 64
BLOCK = ARITY**LEVELS
_POWERS = [ARITY**k for k in range(LEVELS + 1)]


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hashed(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: of each field ``-`` if null, else its bytes in UTF-8, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _climb(nodes: Column, of: Column) -> Column:
    """Up to six levels over a block's hashes: the preimages of each level's parents, and the hash on top. ``of``: nodes of the whole tree at the block's foot."""
    def up(state: Column, k: Column) -> Column:
        low = state["nodes"]
        preimages = F.transform(F.sequence(F.lit(1), F.size(low), F.lit(ARITY)), lambda i: F.array_join(F.slice(low, i, F.lit(ARITY)), ""))
        higher = _let(preimages, lambda p: F.struct(F.transform(p, hashed).alias("nodes"), F.concat(state["parents"], F.array(p)).alias("parents")))
        return F.when(of > F.element_at(F.array(*[F.lit(p) for p in _POWERS]), k), higher).otherwise(state)

    start = F.struct(nodes.alias("nodes"), F.array().cast("array<array<string>>").alias("parents"))
    return F.reduce(F.sequence(F.lit(1), F.lit(LEVELS)), start, up, lambda s: F.struct(s["parents"].alias("parents"), s["nodes"][0].alias("top")))


def _way(parents: Column, at: Column) -> Column:
    """What stands left and right of node ``at`` of a block, and of each of its ancestors, in the parents' preimages."""
    power = lambda k: F.element_at(F.array(*[F.lit(p) for p in _POWERS]), k)
    step = lambda x, k: F.floor(x / power(k)).cast("int")

    def around(preimages: Column, k: Column) -> Column:
        slot = HEX * (step(at, k + 1) % ARITY)
        return _let(preimages[step(at, k + 2)], lambda p: F.struct(p.substr(F.lit(1), slot).alias("left"), p.substr(slot + HEX + 1, F.lit(ARITY * HEX)).alias("right")))

    return F.transform(parents, around)


def build(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stored blocks over ``nodes`` (tree, rank, of, hash), six levels after six: tree, block, of, parents, top."""
    out = []
    while True:
        by = nodes.groupBy("tree", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.first("of").alias("of"), F.sort_array(F.collect_list(F.struct("rank", "hash"))).alias("nodes"))
        by = by.select("tree", "block", "of", _climb(F.col("nodes")["hash"], F.col("of")).alias("up")).select("tree", "block", "of", "up.parents", "up.top")
        out.append(stored(by, f"{name}-blocks"))
        nodes = out[-1].filter(F.col("of") > BLOCK).select("tree", F.col("block").alias("rank"), F.ceil(F.col("of") / BLOCK).alias("of"), F.col("top").alias("hash"))
        if nodes.isEmpty():
            return out


def tops(blocks: list[DataFrame]) -> DataFrame:
    """tree, hash: the root of each tree."""
    out = None
    for b in blocks:
        one = b.filter(F.col("of") <= BLOCK).select("tree", F.col("top").alias("hash"))
        out = one if out is None else out.unionByName(one)
    return out


def ways(blocks: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """The lowest blocks with ``up``, the way from their tops to the root; ``ends`` (tree, up, further columns) holds the way from each tree's root, and goes down with it."""
    carried, above = [c for c in ends.columns if c != "tree"], None
    for level in reversed(range(len(blocks))):
        here = blocks[level].filter(F.col("of") <= BLOCK).join(ends, "tree").select("tree", "block", "parents", *carried)
        if above is not None:
            here = here.unionByName(blocks[level].join(above, ["tree", "block"]).select("tree", "block", "parents", *carried))
        if level == 0:
            return stored(here, f"{name}-ways")
        nodes = blocks[level - 1].filter(F.col("of") > BLOCK).select("tree", F.col("block").alias("node"), F.floor(F.col("block") / BLOCK).alias("block"))
        above = nodes.join(here, ["tree", "block"]).withColumn("up", F.concat(_way(F.col("parents"), F.col("node") % BLOCK), "up")).select("tree", F.col("node").alias("block"), *carried)


def proofs(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with ``way``: left and right of it and of each ancestor up to the last root, and what the ends carry."""
    j = nodes.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(found, ["tree", "block"])
    return j.withColumn("way", F.concat(_way(F.col("parents"), F.col("rank") % BLOCK), "up")).drop("block", "parents", "up")


def folded(node: Column, way: Column) -> Column:
    """The root that a node's hash leads to between the given siblings."""
    return F.reduce(way, node, lambda h, s: hashed(F.concat(s["left"], h, s["right"])))


def siblings(way: Column) -> Column:
    """All siblings from the leaf to the root, left to right."""
    return F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, doc_id, hash, further columns; a stored table) with subroot, root and way.

    A tree's name must order as its place among the roots does, and have no null.
    """
    placed = stored(ranked(leaves, "tree", ["doc_id", "hash"], "merkle"), "merkle-leaves")
    blocks = build(placed, "merkle")
    roots = stored(tops(blocks).select(F.lit("").alias("tree"), F.col("tree").alias("of_tree"), "hash"), "merkle-roots")
    forest = stored(ranked(roots, "tree", ["of_tree"], "merkle-forest"), "merkle-subroots")
    over = build(forest, "merkle-forest")
    last = tops(over).select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("up"), F.col("hash").alias("root"))
    ends = proofs(forest, ways(over, last, "merkle-forest")).select(F.col("of_tree").alias("tree"), F.col("way").alias("up"), F.col("hash").alias("subroot"), "root")
    return proofs(placed, ways(blocks, stored(ends, "merkle-ends"), "merkle"))


def documents_leaves(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """tree, doc_id, hash of each document, and ``other``: the hash with another text in place of its own."""
    fields = [F.col(f) for f in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree")
    more = [] if other is None else [leaf([*fields[:-1], other]).alias("other")]
    return stored(docs.select(tree, "doc_id", leaf(fields).alias("hash"), *more), "merkle-hashes")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document's proof, and whether its row leads to the root after lines are joined in every second document."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(documents_leaves(docs, text))
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", hashed(siblings(F.col("way"))).alias("proof_sha256"), folded(F.col("other"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
