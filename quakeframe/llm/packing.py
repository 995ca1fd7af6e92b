"""Packing of token sequences by cutting stock: patterns of lengths from a linear program with generated columns.

Each document's ids (an end id included) are cut into whole sequences of ``LENGTH`` and a rest. The rests' histogram, by
length classes, is the demand of a cutting-stock program: a column is a pattern, a multiset of classes that fits into a
sequence, and a knapsack over the dual prices finds the columns that lower the number of sequences. The rounded patterns
take the rests of each class by rank. Ids are made once, where the texts lie; what is stored and shuffled is a row for
each piece, with its checksum. The driver holds the histogram (a row for each length under ``LENGTH``) and the patterns.

Classes are exact up to 256 ids and 4 and 8 wide above, so that the program has at most 832 rows; a rest may leave as
many ids less one unused. The program stops where its sequences are within ``GAP`` of the lower bound that the last
knapsack proves, or after ``PIVOTS`` exchanges (every basis covers the demand). Rests that rounding leaves over are packed best fit, longest first.

Defined results: a null or empty text has the end id alone. Rows with null or repeated ids are packed like all others.
Very long texts are encoded word by word, so that their ids are the only thing of their length. An empty table gives no
piece. Further columns are left out.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import small, stored, text_batches

LENGTH = 4096
END = 2
GAP = 5e-4
PIVOTS = 1500
#: Words kept with their ids in a task; longer words than WORD_CHARS are encoded anew each time.
WORDS = 500_000
WORD_CHARS = 100
SIZES = np.concatenate([np.arange(1, 257), np.arange(260, 1025, 4), np.arange(1032, LENGTH, 8), [LENGTH]])
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, k long"


def _ends_in_letter(word: str) -> bool:
    """Whether a word ends in a letter once the tokenizer has composed it and put it into lower case."""
    return word[-1:].isalpha() if word.isascii() else unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class WordIds(dict):
    """Ids of a word (a run without ASCII white space) as little-endian unsigned integers of 32 bits.

    The tokenizer drops white space and lets no token reach over it, so a text's ids are those of its words in order. It
    also cuts between a letter and such a mark as those of ``MARKS`` (which no special token has), so marks at a word's
    end are looked up for themselves.
    """

    MARKS = ".,;:!?#$%&*"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size())]
        self.last = np.array([t.endswith("</w>") for t in names])

    def _encode(self, words: list[str]) -> None:
        """Learn the ids of words. Those of letters alone are one run for the tokenizer, so that their ids end where a token does that ends a run."""
        runs = [w for w in words if w.isalpha()]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(runs):
            self._learn(runs, ids, ends)
        rest = [w for w in words if w not in self]  # and letters whose lower case has marks
        if rest:
            found = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            self._learn(rest, np.array(found.ids, dtype="<u4"), np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(rest)), side="right"))

    def _learn(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        data, stops = ids.tobytes(), (4 * ends).tolist()
        self.update((w, data[a:z]) for w, a, z in zip(words, [0, *stops], stops, strict=False))

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words. ``WORDS`` of them are kept for later, besides those at hand."""
        if len(self) > WORDS:  # those of these texts stay, and so the frequent ones
            kept = {w: self[w] for w in words if w in self}
            self.clear()
            self.update(kept)
        heads = {}
        for w in words:
            if w not in self:
                head = w.rstrip(self.MARKS)
                heads[w] = head if _ends_in_letter(head) else w
        parts = set(heads.values()).union(w[len(h) :] for w, h in heads.items() if len(w) > len(h)).difference(self)
        if parts:
            self._encode(sorted(parts))
        ids = [self[w] if w in self else self[heads[w]] + self[w[len(heads[w]) :]] for w in words]
        for w in [w for w in parts if len(w) > WORD_CHARS]:
            del self[w]
        return ids

    def of_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        column = pa.array(texts, pa.string())
        lower = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))  # the tokenizer does so, but for special tokens
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        ids = self.of_words(words.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        flat = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<u4"))).take(words.indices)
        data, at = flat.flatten().to_numpy(), flat.offsets.to_numpy()[split.offsets.to_numpy()]
        for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield data[a:z].tobytes()


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words known to this Python worker, which may run many tasks."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def _cut(path: str, length: int, end: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts to rows of their pieces; ``k`` numbers the task's pieces of a class."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, last = word_ids(path), np.zeros(len(SIZES), dtype=np.int64), np.array([end], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        for columns, texts in text_batches(batches, chars=12_000_000):
            rows = []
            for doc_id, ids in zip(columns["doc_id"], words.of_texts(texts), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    kind = int(np.searchsorted(SIZES, len(piece) // 4))
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n, kind, part, int(seen[kind])))
                    seen[kind] += 1
            names = [c.split()[0] for c in _PIECE.split(", ")]
            types = [pa.int32() if c.endswith(" int") else pa.int64() for c in _PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def pieces(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """The stored pieces of all documents, each with its class and its number among the task's pieces of that class."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, LENGTH, end), _PIECE), "packing-pieces")


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product in this thread alone: the library's threads would wait for each other beside Spark's."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, each time with the largest entry of the column, in this thread alone."""
    a, out = matrix.copy(), np.eye(len(matrix))
    for k in range(len(a)):
        at = k + int(np.abs(a[k:, k]).argmax())
        a[[k, at]], out[[k, at]] = a[[at, k]], out[[at, k]]
        scale = a[k, k]
        a[k], out[k] = a[k] / scale, out[k] / scale
        way = a[:, k].copy()
        way[k] = 0
        rows = np.flatnonzero(way)
        a[rows] -= way[rows, None] * a[k]
        out[rows] -= way[rows, None] * out[k]
    return out


class _Program:
    """Least sequences over ``demand`` (how often each of ``sizes``, ascending, is wanted): a revised simplex that prices patterns by a knapsack."""

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        self.sizes, self.demand, self.capacity = sizes, demand.astype(float), capacity
        self.fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
        fill = capacity // sizes
        self.basis, self.cost, self.inverse = np.diag(fill).astype(float), np.ones(len(sizes)), np.diag(1 / fill)  # columns

    def _filled(self) -> np.ndarray:
        """Columns to begin with, longest class first: a pattern of what is left of the class, filled with smaller ones of which enough is left."""
        m, left, out = len(self.sizes), self.demand.copy(), []
        for i in reversed(range(m)):
            if left[i] <= 1e-9:
                continue
            row, room = np.zeros(m, dtype=np.float32), self.capacity
            most = min(room // self.sizes[i], max(1, int(left[i])))
            row[i] = most
            room -= most * self.sizes[i]
            times = left[i] / most
            for j in reversed(range(min(i, self.fitting[room]))):
                if self.sizes[j] <= room and left[j] >= times:
                    row[j] = min(room // self.sizes[j], int(left[j] / times))
                    room -= int(row[j]) * self.sizes[j]
            left -= row * times
            out.append(row)
        return np.array(out)

    def knapsack(self, price: np.ndarray) -> tuple[float, np.ndarray]:
        """The best value of a pattern, and for each class the best pattern that holds it."""
        best, pick = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        for c in range(1, self.capacity + 1):
            best[c] = best[c - 1]
            if k := self.fitting[c]:
                value = best[c - self.sizes[:k]] + price[:k]
                j = int(value.argmax())
                if value[j] > best[c]:
                    best[c], pick[c] = value[j], j
        out = np.zeros((len(self.sizes), len(self.sizes)), dtype=np.float32)
        for i, size in enumerate(self.sizes):
            out[i, i] = 1
            c = self.capacity - size
            while c > 0:
                if pick[c] < 0:
                    c -= 1
                else:
                    out[i, pick[c]] += 1
                    c -= self.sizes[pick[c]]
        return float(best[-1]), out

    def pivot(self, column: np.ndarray, cost: float, amount: np.ndarray) -> None:
        way = _times(self.inverse, column)
        ratio = np.where(way > 1e-7, amount / np.where(way > 1e-7, way, 1), np.inf)
        out = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-9, way, 0).argmax())  # of those that leave first, the safest to divide by
        self.basis[:, out], self.cost[out] = column, cost
        row = self.inverse[out] / way[out]
        self.inverse -= np.outer(way, row)
        self.inverse[out] = row

    def solve(self, gap: float, pivots: int) -> tuple[np.ndarray, np.ndarray]:
        """Patterns (rows) and how often to use each, in fractions: after any number of pivots they cover the demand."""
        pool, least = self._filled(), float((self.sizes * self.demand).sum()) / self.capacity
        for turn in range(pivots):
            stale = turn % 250 == 249
            if turn % 50 == 49 and np.abs(_times(self.basis, _times(self.inverse, self.demand)) - self.demand).max() > 1e-6:
                self.inverse = _inverse(self.basis)
            amount, price = np.maximum(_times(self.inverse, self.demand), 0), _times(self.inverse.T, self.cost)
            total = float((amount * self.cost).sum())
            if total <= max((1 + gap) * least, np.ceil(least - 1e-6)):  # no whole number of sequences lies between
                break
            if price.min() < -1e-6:  # a class wanted less than it is cut: its surplus enters
                self.pivot(-np.eye(1, len(price), int(price.argmin()))[0], 0.0, amount)
                continue
            worth = _times(pool, price)
            if worth.max() <= 1 + 1e-6 or stale:  # now and then for the bound alone
                top, found = self.knapsack(price)
                least = max(least, total / max(top, 1))
                worth = _times(found, price)
                if worth.max() <= 1 + 1e-6:
                    break
                pool = np.unique(np.concatenate([pool[_times(pool, price) > 0.98], found[worth > 1 + 1e-6]]), axis=0)
                worth = _times(pool, price)
            self.pivot(pool[int(worth.argmax())].astype(float), 1.0, amount)
        used = self.cost > 0
        return self.basis[:, used].T.round().astype(int), np.maximum(_times(self.inverse, self.demand), 0)[used]


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for what is left, longest first, each where least room stays."""
    room, rows = np.zeros(int(left.sum()), dtype=np.int64), []
    for i in reversed(range(len(sizes))):
        n = int(left[i])
        while n:
            fits = np.flatnonzero(room[: len(rows)] >= sizes[i])
            if len(fits):
                at = int(fits[room[fits].argmin()])
            else:
                at = len(rows)
                room[at] = capacity
                rows.append(np.zeros(len(sizes), dtype=np.int64))
            q = min(n, int(room[at] // sizes[i]))
            rows[at][i] += q
            room[at] -= q * sizes[i]
            n -= q
    return rows


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int = LENGTH, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """(times, classes in one sequence): whole patterns that hold at least ``demand`` of each class."""
    if not len(sizes):
        return []
    rows, amount = _Program(sizes, demand, capacity).solve(gap, PIVOTS)
    left, out = demand.astype(np.int64).copy(), []
    whole = np.floor(amount + 1e-7).astype(np.int64)
    for k in np.argsort(whole - amount, kind="stable"):  # those that lose most by rounding first
        row = rows[k].astype(np.int64)
        at = row > 0
        times = min(int(np.ceil(amount[k] - 1e-7)), int((left[at] // row[at]).min())) if at.any() else 0
        if times > 0:
            out.append((times, row))
            left -= times * row
    loose: dict[bytes, int] = {}
    for row in _best_fit(sizes, left, capacity):
        loose[row.tobytes()] = loose.get(row.tobytes(), 0) + 1
    return out + [(n, np.frombuffer(row, dtype=np.int64)) for row, n in loose.items()]


def _places(plan: list[tuple[int, np.ndarray]], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Runs of ranks for each class: (class, first rank) in order, and (times, first sequence, first slot) of each; and the number of sequences."""
    used, keys, runs, base = np.zeros(len(classes), dtype=np.int64), [], [], 0
    for times, row in plan:
        slot = 0
        for i in np.flatnonzero(row):
            keys.append((classes[i], used[i]))
            runs.append((times, base, slot))
            used[i] += times * row[i]
            slot += int(row[i])
        base += times
    order = sorted(range(len(keys)), key=lambda k: keys[k])
    return np.array([keys[k] for k in order], dtype=np.int64).reshape(-1, 2), np.array([runs[k] for k in order], dtype=np.int64).reshape(-1, 3), base


def _assign(keys: np.ndarray, runs: np.ndarray, sequences: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranked pieces to their sequence and slot there. A piece of a whole sequence has one of its own after the others."""
    top = len(SIZES) - 1
    first = {int(c): int(np.searchsorted(keys[:, 0], c)) for c in np.unique(keys[:, 0])}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, rank = b.column("class").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = sequences + rank, np.zeros(len(rank), dtype=np.int64)
            for c in np.unique(kind[kind != top]):
                at = np.flatnonzero(kind == c)
                lo, hi = first[int(c)], int(np.searchsorted(keys[:, 0], c, side="right"))
                j = lo + np.searchsorted(keys[lo:hi, 1], rank[at], side="right") - 1
                times, base, start = runs[j].T
                along = rank[at] - keys[j, 1]
                sequence[at], slot[at] = base + along % times, start + along // times
            kept = [c for c in b.schema.names if c not in ("class", "rank")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sequence), pa.array(slot)], names=[*kept, "sequence_id", "slot"])

    return run


def pack(cut: DataFrame, gap: float = GAP) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces are ranked within their class by the task that cut them and their number there."""
    counts = stored(cut.groupBy("class", "part").agg(F.count("*").alias("n")), "packing-counts")
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = stored(counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "packing-shifts")
    demand = {r["class"]: r["n"] for r in counts.filter(F.col("class") < len(SIZES) - 1).groupBy("class").agg(F.sum("n").alias("n")).collect()}
    classes = np.array(sorted(demand), dtype=np.int64)
    plan = patterns(SIZES[classes], np.array([demand[c] for c in classes], dtype=np.int64), LENGTH, gap)
    ranks = cut.join(small(shifts), ["class", "part"]).withColumn("rank", F.col("k") + F.col("shift"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranks.select(*kept, "class", "rank").mapInArrow(_assign(*_places(plan, classes)), ", ".join(f"{c} long" for c in [*kept, "sequence_id", "slot"]))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The contract's rows: every piece with its sequence and offset."""
    return pack(pieces(docs, path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
