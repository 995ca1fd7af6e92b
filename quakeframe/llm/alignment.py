"""Alignment of two tokenizers' ids: which tokens of one lie over which of the other, and how common each pair is.

Texts are encoded by both tokenizers where they lie, word by word: a stretch of white space with the letters after it is
a unit that no token of either reaches over (checked against the vocabularies), so the units' tokens, groups and
overlaps are kept and put together for a text. A document's pairs go out as postings with their multiplicities, packed
by batch of documents and first id. Postings are dealt to buckets of about ``BUCKET`` by that id; an id with more of
them has several buckets, whose counts come as totals summed before, cogrouped to each. A bucket, of bounded size, counts
the documents of its pairs, finds each id's best, and gives back sums by document, packed by batch, which are summed once more batch by batch.

Defined results: texts null, empty, or which a tokenizer doesn't give back byte by byte have no tokens, zeros, and an
empty digest. Rows are told apart by their place, so that null and repeated ids are documents of their own. Very long
texts are encoded unit by unit. An empty table gives no row. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import stored, text_batches

#: Postings in a bucket, about; units that a Python worker keeps, and the longest of them.
BUCKET = 1_000_000
UNITS = 200_000
UNIT_CHARS = 60
#: The code points of white space in the first tokenizer's pattern. A unit begins at one of STARTS after anything else.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STARTS = " \n\t"
_REST = "".join(c for c in SPACE if c not in STARTS)
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{_REST}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")
_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, first long, at array<int>, b array<int>, m array<int>"
_SIDE = 1 << 15  # ids of the second tokenizer are smaller


def _bytes_of_a(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose characters stand for bytes: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    names = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in names]


def _bytes_of_b(pieces: list[str]) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in pieces]


class Units(dict):
    """What a unit's alignment is: its groups as text, its pairs (packed as 32-bit integers), its numbers of A tokens, B tokens and groups (packed in one integer); None if it is not given back whole."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE}\u2581][\u2581{STARTS}]", p) for p in pieces) or len(pieces) > _SIDE:
            raise ValueError("a piece reaches over the start of a unit")
        self.of_a, self.of_b = _bytes_of_a(self.a), _bytes_of_b(pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in of]) for of in (self.of_a, self.of_b))
        self.signs = pa.array([f"{k}{sign}" for sign in ",|;" for k in range(len(self.of_a))])
        self.lead = self.b.piece_to_id("\u2581a")

    def learn(self, units: list[str]) -> None:
        """Align units. Those that end in white space, or that have the second tokenizer's sign for it, are encoded one by one, the others as one text."""
        alone = [u for u in units if u[-1] in SPACE or "\u2581" in u]
        together = [u for u in units if u[-1] not in SPACE and "\u2581" not in u]
        for some in ([together] if together else []) + [[u] for u in alone]:
            data = [u.encode("utf-8", "replace") for u in some]
            a = self.a.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids
            b = self.b.encode("a" + "".join(some))
            if b[0] != self.lead:
                raise ValueError("the second tokenizer joins what stands before a unit")
            if b"".join(map(self.of_a.__getitem__, a)) == b"".join(data) == b"".join(map(self.of_b.__getitem__, b[1:])):
                self.update(zip(some, self._aligned(np.cumsum([len(d) for d in data]), np.array(a), np.array(b[1:])), strict=True))
            elif len(some) == 1:
                self[some[0]] = None
            else:  # some are not given back whole
                middle = len(some) // 2
                self.learn(some[:middle])
                self.learn(some[middle:])

    def _aligned(self, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
        """What each unit holds, from the ids of all and the units' ends. Between two neighbouring ends of tokens, of either side, lies one overlap."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        cuts, groups = both[np.diff(both, prepend=-1) > 0], both[1:][both[1:] == both[:-1]]
        pairs = (a[np.searchsorted(ends_a, cuts)] * _SIDE + b[np.searchsorted(ends_b, cuts)]).astype("<i4").tobytes()
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        written = np.empty(len(a) + len(b), dtype=np.int64)  # ids with the sign after them, in the order of the text
        written[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(self.of_a) * (ends_a == groups[group_a])
        written[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = b + len(self.of_a) * 2 * (ends_b == groups[group_b])
        said = self.signs.take(pa.array(written))
        text, at = said.buffers()[2].to_pybytes(), np.frombuffer(said.buffers()[1], dtype=np.int32)
        in_a, in_b, in_cuts, in_groups = (np.searchsorted(x, ends, side="right") for x in (ends_a, ends_b, cuts, groups))
        last = (0, 0, 0, 0, 0)
        for now in zip(at[in_a + in_b].tolist(), (4 * in_cuts).tolist(), in_a.tolist(), in_b.tolist(), in_groups.tolist(), strict=True):
            yield text[last[0] : now[0] - 1], pairs[last[1] : now[1]], now[2] - last[2] << 80 | now[3] - last[3] << 40 | now[4] - last[4]
            last = now

    def of_texts(self, texts: list[str]) -> Iterator[list[tuple[bytes, bytes, int] | None]]:
        """The units of each text, after a space; none for an empty one."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        used = set().union(*split)
        if len(self) > UNITS:  # those of these texts stay, and so the frequent ones
            kept = {u: self[u] for u in used if u in self}
            self.clear()
            self.update(kept)
        new = used.difference(self)
        if new:
            self.learn(sorted(new))
        for units in split:
            yield [self[u] for u in units]
        for u in new:
            if len(u) > UNIT_CHARS:
                del self[u]


_units: dict[tuple[str, str], Units] = {}


def units(path_a: str, path_b: str) -> Units:
    """The units known to this Python worker, which may run many tasks."""
    if (path_a, path_b) not in _units:
        _units[path_a, path_b] = Units(path_a, path_b)
    return _units[path_a, path_b]


def _encode(path_a: str, path_b: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts to a row for each document, and one for each first id of a batch with its postings."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, _ROWS.split(", "), strict=True)])
    mask = (1 << 40) - 1

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = units(path_a, path_b), TaskContext.get().partitionId() << 33
        for columns, texts in text_batches(batches, chars=3_000_000):
            rows, codes, at = [], [], []
            for k, (doc_id, found) in enumerate(zip(columns["doc_id"], known.of_texts(texts), strict=True)):
                if not found or None in found:
                    rows.append((first + k, doc_id, 0, 0, 0, 0, ""))
                    continue
                pairs = np.frombuffer(b"".join([f[1] for f in found]), dtype="<i4")
                sums = sum([f[2] for f in found])
                digest = hashlib.sha256(b";".join([f[0] for f in found])).hexdigest()
                rows.append((first + k, doc_id, sums >> 80, sums >> 40 & mask, sums & mask, len(pairs), digest))
                codes.append(pairs)
                at.append(k)
            yield batch(len(rows), **dict(zip(names, zip(*rows, strict=True), strict=False)))
            if codes:
                yield postings(first, np.concatenate(codes), np.repeat(at, [len(c) for c in codes]))
            first += len(texts)

    def postings(first: int, code: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        key = np.sort(code.astype(np.int64) << 32 | at)  # by first id, second id, document
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        key, m = key[starts], np.diff(np.append(starts, len(key)))
        code = key >> 32
        a, starts = np.unique(code // _SIDE, return_index=True)
        offsets = pa.array(np.append(starts, len(key)), pa.int32())
        lists = {n: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for n, v in (("at", key & 0xFFFFFFFF), ("b", code % _SIDE), ("m", m))}
        have = {"a": pa.array(a.astype(np.int32)), "first": pa.array(np.full(len(a), first)), **lists}
        return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(len(a), f.type)) for f in schema], schema=schema)

    return run


def encode(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """A row for each document (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256), and the postings (a, first, at, b, m): documents ``first + at`` hold a and b linked m times."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path_a, path_b), _ROWS), "alignment-rows")
    return rows.filter(F.col("row").isNotNull()).select(*names[:7]), rows.filter(F.col("a").isNotNull()).select(*names[7:])


def _contributions(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's postings, and totals where its id has other buckets, to the sums of each document."""
    lists = {n: left.column(n).combine_chunks() for n in ("at", "b", "m")}
    sizes = np.diff(lists["at"].offsets.to_numpy())
    flat = {n: c.flatten().to_numpy().astype(np.int64) for n, c in lists.items()}
    code = np.repeat(left.column("a").to_numpy().astype(np.int64), sizes) * _SIDE + flat["b"]
    row = np.repeat(left.column("first").to_numpy(), sizes) + flat["at"]
    pair, which, n = np.unique(code, return_inverse=True, return_counts=True)
    if right.num_rows:
        b, total = right.column("b").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(b)
        n, most = total[order][np.searchsorted(b[order], pair % _SIDE)], total.max()
    else:
        starts = np.flatnonzero(np.diff(pair // _SIDE, prepend=-1))
        most = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(pair)))) if len(pair) else n
    best, count = flat["m"] * (n == most)[which], flat["m"] * n[which]
    return _packed(*_summed(row, best, count), left.column("first").to_numpy())


def _summed(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different rows, and the sums of each of ``values`` over them."""
    order = np.argsort(row, kind="stable")
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    return row[order][starts], *[np.add.reduceat(v[order], starts) if len(row) else v for v in values]


def _packed(row: np.ndarray, best: np.ndarray, count: np.ndarray, batches: np.ndarray) -> pa.Table:
    """Sums of documents, a row for each batch of documents."""
    first = np.unique(batches)
    ends = pa.array(np.append(np.searchsorted(row, first), len(row)), pa.int32())
    return pa.table({"first": first} | {n: pa.ListArray.from_arrays(ends, pa.array(v)) for n, v in (("row", row), ("n_best", best), ("count_sum", count))})


def _by_document(key: tuple, parts: pa.Table) -> pa.Table:
    """The sums of a batch's documents over all buckets."""
    sums = _summed(*[parts.column(n).combine_chunks().flatten().to_numpy() for n in ("row", "n_best", "count_sum")])
    return pa.table(dict(zip(("row", "n_best", "count_sum"), sums, strict=True)))


def link_sums(postings: DataFrame) -> DataFrame:
    """row, n_best, count_sum of each document that has links."""
    spark = postings.sparkSession
    sizes = {r["a"]: r["n"] for r in postings.groupBy("a").agg(F.sum(F.size("at")).alias("n")).collect()}  # a row for each id of the vocabulary at most
    dealt, bucket, room = [], -1, 0
    for a in sorted(sizes):
        parts = -(-sizes[a] // BUCKET)
        if parts > 1 or sizes[a] > room:
            bucket, room = bucket + 1, BUCKET
        dealt.append((a, bucket, parts))
        bucket, room = (bucket + parts - 1, 0) if parts > 1 else (bucket, room - sizes[a])
    to = F.broadcast(spark.createDataFrame(dealt, "a int, bucket long, parts long"))
    placed = postings.join(to, "a").withColumn("bucket", F.col("bucket") + F.pmod(F.xxhash64("first"), F.col("parts")))
    hot = placed.filter(F.col("parts") > 1).select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    totals = stored(hot, "alignment-totals").join(to, "a").select(F.explode(F.sequence(F.col("bucket"), F.col("bucket") + F.col("parts") - 1)).alias("bucket"), "b", "n")
    sums = placed.select("bucket", "a", "first", "at", "b", "m").groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(_contributions, "first long, row array<long>, n_best array<long>, count_sum array<long>")
    return sums.groupBy("first").applyInArrow(_by_document, "row long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The contract's rows."""
    rows, postings = encode(docs, path_a, path_b)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return rows.join(link_sums(postings), "row", "left").select(*kept, zero("n_best"), zero("count_sum"), "groups_sha256")
