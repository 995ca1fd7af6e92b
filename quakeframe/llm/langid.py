"""Language identification by cross-parsing entropy.

For each language a reference text is learned and a suffix automaton built over it; completed with restarts it is a
deterministic machine that cuts any text into the longest pieces that occur in the reference. The fewer phrases a
language needs, the closer the text is to it: phrases times the bits of a position in the reference, over the length
of the text, estimate the cross entropy, and the lowest wins (ties: the first language by name).

Texts are lower-cased, runs of anything but letters (with their marks) become one space, and blocks of ``BLOCK``
characters are parsed on their own, all blocks and languages of a batch side by side. Every character is parsed. The
reference is a bounded sample: up to REFERENCE characters for each language (fewer where REFERENCES would be passed
for all together, or where a machine would outgrow CELLS), in pieces from anywhere in the documents of the smallest
id hashes: first a piece of each document, then further ones, until the reference is full. Languages whose machines
do not fit CELLS together are parsed group by group.

Defined results: null texts and texts without a letter (numbers such as a half are none) are ``und`` with score 0;
without any learned language all are; documents without a language or an id are not learned from; rows repeated with
one id each get a row (and in learning count once for each language and text); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import fold, letters_in, small, stored, text_batches

REFERENCE = 30_000
REFERENCES = 3_000_000
#: Characters of a piece; parts of a language's documents by hash, and the documents that each part gives at most.
PIECE = 2_000
PARTS = 32
PART_DOCUMENTS = 16
#: Entries of the transition table that a task holds at once.
CELLS = 32_000_000
BLOCK = 512


def normal(text: str) -> str:
    """Lower-case letters, with one space for everything between."""
    low = text.lower()
    return " ".join(letters_in(low).findall(low))


RESTART = 1 << 30


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the root."""
    nexts: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


@dataclass
class Machine:
    """A language's automaton: its letters and states, and its moves as states, letters and next states."""

    letters: str
    states: int
    moves: np.ndarray


@dataclass
class Table:
    """The machines of some languages in one table: next state of (state, letter), with RESTART added where a new phrase begins."""

    lookup: np.ndarray
    table: np.ndarray
    roots: np.ndarray


@dataclass
class Parser:
    """The machines of all languages, the bits of a position in their references, and the groups that are parsed together."""

    langs: list[str]
    machines: list[Machine]
    bits: np.ndarray
    groups: list[list[int]]
    held: dict[int, Table] = field(default_factory=dict)

    def table(self, k: int) -> Table:
        if k not in self.held:
            self.held.clear()
            self.held[k] = tabulate([self.machines[m] for m in self.groups[k]])
        return self.held[k]


def machine(text: str) -> Machine:
    nexts = automaton(text)
    letters = "".join(sorted(set(text)))
    at = {c: k for k, c in enumerate(letters)}
    moves = np.array([(s, at[c], t) for s, found in enumerate(nexts) for c, t in found.items()], dtype=np.int32).reshape(-1, 3)
    return Machine(letters, len(nexts), moves)


def build(references: dict[str, str], cells: int = CELLS) -> Parser:
    """The machines of the reference texts by language; a reference whose machine would outgrow ``cells`` is halved until it fits."""
    langs = sorted(references)
    machines, sizes = [], []
    for lang in langs:
        text = references[lang]
        while (found := machine(text)).states * (len(found.letters) + 1) > cells:
            text = text[: len(text) // 2]
        machines.append(found)
        sizes.append(max(len(text), 2))
    groups: list[list[int]] = []
    letters, states = set(), 0
    for k, m in enumerate(machines):
        letters, states = letters | set(m.letters), states + m.states
        if not groups or states * (len(letters) + 1) > cells:
            groups.append([])
            letters, states = set(m.letters), m.states
        groups[-1].append(k)
    return Parser(langs, machines, np.log2(np.array(sizes, dtype=float)), groups)


def tabulate(machines: list[Machine]) -> Table:
    letters = "".join(sorted({c for m in machines for c in m.letters}))
    lookup = np.zeros(0x110000, dtype=np.int32)  # 0: any letter that no reference has
    for k, c in enumerate(letters):
        lookup[ord(c)] = k + 1
    tables, roots, base = [], [], 0
    for m in machines:
        table = np.full((m.states, len(letters) + 1), -1, dtype=np.int64)
        own = np.array([lookup[ord(c)] for c in m.letters], dtype=np.int64)
        table[m.moves[:, 0], own[m.moves[:, 1]]] = m.moves[:, 2]
        root = np.where(table[0] < 0, 0, table[0])  # a letter that the reference lacks is a phrase of its own
        table = np.where(table < 0, root + RESTART, table)
        table[0] = root + RESTART
        tables.append((table + base).astype(np.int32))
        roots.append(base)
        base += m.states
    return Table(lookup, np.concatenate(tables), np.array(roots, dtype=np.int32))


def phrases(parser: Parser, texts: list[str]) -> np.ndarray:
    """Phrases that each language needs for each normalised text (texts x languages)."""
    if not parser.groups:
        return np.zeros((len(texts), 0), dtype=np.int64)
    return np.concatenate([_phrases(parser.table(k), texts) for k in range(len(parser.groups))], axis=1)


def _phrases(machines: Table, texts: list[str]) -> np.ndarray:
    n_langs = len(machines.roots)
    out = np.zeros((len(texts), n_langs), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = machines.lookup[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    n_blocks = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(texts)), n_blocks)
    if not len(doc):
        return out
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + inner * BLOCK
    length = np.minimum(BLOCK, sizes[doc] - inner * BLOCK)
    order = np.argsort(-length, kind="stable")
    doc, start, length = doc[order], start[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    width, flat = machines.table.shape[1], machines.table.reshape(-1)
    state = np.repeat(machines.roots[:, None], len(doc), axis=1)
    count = np.zeros((n_langs, len(doc)), dtype=np.int32)
    for t, n in enumerate(alive.tolist()):
        to = flat.take(state[:, :n] * np.int32(width) + codes[start[:n] + t])
        count[:, :n] += to >> 30
        state[:, :n] = to & (RESTART - 1)
    for k in range(n_langs):
        out[:, k] = np.bincount(doc, count[k], minlength=len(texts))
    return out


def predict(parser: Parser, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score compares the best language's bits a character with all languages'."""
    cleaned = [normal(t) for t in texts]
    found = phrases(parser, cleaned) * parser.bits
    langs, scores = [], []
    for text, cost in zip(cleaned, found, strict=True):
        if not text or not len(cost):
            langs.append("und")
            scores.append(0.0)
            continue
        best = int(np.argmin(cost))
        each = np.exp2(-8.0 * (cost - cost[best]) / max(cost[best], 1.0))
        langs.append(parser.langs[best])
        scores.append(float(1 / each.sum()))
    return langs, scores


def pieces(chosen: DataFrame, rounds: int) -> DataFrame:
    """of, key, doc_id, round, piece: normalised texts cut into pieces of PIECE characters, numbered in an order of hash; those of the first ``rounds`` only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in text_batches(batches):
            rows = []
            for of, key, doc, text in zip(rest["of"], rest["key"], rest["doc_id"], texts, strict=True):
                clean = normal(text)
                cuts = sorted(range(0, len(clean), PIECE), key=lambda a: (xxhash.xxh64_intdigest(f"{doc} {a}"), a))
                rows += [(of, key, doc, n, clean[a : a + PIECE]) for n, a in enumerate(cuts[:rounds])]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["of", "key", "doc_id", "round", "piece"])

    return chosen.select("of", "key", "doc_id", "text").mapInArrow(run, "of string, key long, doc_id long, round int, piece string")


def learn(documents: DataFrame, most: int = REFERENCE) -> Parser:
    """Learn from documents outside the held-out fold that have text and lang. At most ``most`` + PIECE characters a language reach the driver."""
    known = documents.select(F.col("doc_id").cast("long"), "text", "lang").filter((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select(F.col("lang").alias("of"), "doc_id", F.xxhash64("doc_id", F.lit(42)).alias("key"), F.xxhash64("text").alias("version"), "text")
    # the documents of the smallest hashes in each part of a language, by ids and hashes alone; their number is bounded for each language
    near = Window.partitionBy("of", F.pmod("key", F.lit(PARTS))).orderBy("key", "doc_id", "version")
    chosen = known.select("of", "doc_id", "key", "version").withColumn("n", F.row_number().over(near)).filter(F.col("n") <= PART_DOCUMENTS)
    chosen = stored(chosen.drop("n").distinct(), "langid-ids")
    langs = chosen.select("of").distinct().count()
    most = min(most, REFERENCES // max(langs, 1))
    texts = known.join(small(chosen), ["of", "doc_id", "key", "version"])
    cut = pieces(texts, -(-most // PIECE)).groupBy("of", "piece").agg(F.min(F.struct("round", "key", "doc_id")).alias("p"))  # equal pieces teach once
    cut = stored(cut.select("of", "piece", "p.*"), "langid-pieces")
    before = F.sum(F.length("piece") + 1).over(Window.partitionBy("of").orderBy("round", "key", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1))
    taken = cut.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most)
    references: dict[str, list[str]] = {}
    for r in taken.select("of", "before", "piece").orderBy("of", "before").toLocalIterator():
        references.setdefault(r["of"], []).append(r["piece"])
    return build({of: " ".join(x)[: most + PIECE] for of, x in references.items()})


def identify(documents: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shipped = documents.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for rest, texts in text_batches(batches, chars=4_000_000):
            langs, scores = predict(model, texts)
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
