"""Language-model scores from a subword lattice.

A text is its words (A-Z in lower case) and one end. A word, with the mark of a word's start in front, is a lattice:
its arcs are the pieces of an existing vocabulary, and one arc over the whole word if training texts have it. The
word's probability is the sum over all segmentations of the product of their arcs' probabilities, by a forward
recursion in log space; a character that is no piece is spelled by byte pieces. No arc reaches over a word's end, so
a text's marginal probability is the product of its words' and the end's.

The vocabulary stays as it is. Its scores, a ranking, give the pieces' first weights by Zipf's law; rounds of
expectation maximisation over all different training words (forward-backward on each word's lattice) turn them into
probabilities, with the first weights as a prior; pieces that start a word sum to one, the others and the word's end
as well. A whole word's arc weighs its count less DISCOUNT, and what the discounts free is the pieces' share: the
probabilities of all words and the end sum to one at most.

Words are a table that grows with the corpus, with their counts and lattice probabilities, each computed once. Those of
the ``HEAD`` most frequent words go to every task; a document's other words are joined with the table by a shuffle. So
hot words are never shuffled and none is dropped.

Defined results: a null text is empty and is an end only; documents with a null id are scored but not learned from;
rows repeated with one id each get a row; an empty table gives an empty result; without training texts the base is
log10(1) for each token, and the score is that of the pieces' first weights; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import fold, stored, text_batches, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
PRIOR = 1000.0
HEAD = 50_000
#: Bytes of a word that goes to every task, at most; longer ones are joined like the rest.
HEAD_BYTES = 200
#: Taken from the count of every different word for the pieces' share.
DISCOUNT = 0.7
#: Different words that a task counts before it passes them on.
HELD = 300_000
START = "▁"
LOG10 = math.log(10)


class Lattice:
    """Pieces with log weights; ``stop`` is the log weight of a word's end."""

    def __init__(self, pieces: dict[str, int], spell: list[int], weights: np.ndarray, stop: float):
        self.pieces, self.spell = pieces, spell
        starts = np.array([k for name, k in pieces.items() if name.startswith(START)])
        group = np.zeros(len(weights), dtype=bool)
        group[starts] = True
        rest = weights[~group].sum() + stop
        self.weights = np.log(np.where(group, weights / weights[group].sum(), weights / rest)).tolist()
        self.stop = math.log(stop / rest)
        # numbers of the pieces, and -1 for what only begins a piece: where neither is found, no longer piece fits
        self.prefixes = {name[:k]: -1 for name in pieces for k in range(1, len(name))} | pieces
        self.logs = {name: self.weights[k] if k >= 0 else 1.0 for name, k in self.prefixes.items()}  # over 0: begins a piece only

    def word(self, word: str) -> float:
        """Natural log of a word's marginal probability over the pieces: the forward sums alone, with no arcs kept."""
        s = START + word
        n, find, exp, log = len(s), self.logs.get, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        alpha = 0.0
        for i in range(n + 1):
            found = into[i]
            if len(found) == 1:
                alpha = found[0]
            else:
                top = max(found)
                alpha = top + log(sum([exp(x - top) for x in found]))
            for j in range(i + 1, n + 1):
                w = find(s[i:j])
                if w is None:
                    break
                if w <= 0:
                    into[j].append(alpha + w)
            if i < n and find(s[i], 1.0) > 0:
                into[i + 1].append(alpha + sum([self.weights[self.spell[b]] for b in s[i].encode("utf-8", "replace")]))
        return alpha + self.stop

    def expect(self, word: str, into_counts: list[float]) -> None:
        """Add the expected uses of the pieces in a word: forward sums, then the share of all segmentations that use each arc."""
        s = START + word
        n, find, weights, exp, log = len(s), self.prefixes.get, self.weights, math.exp, math.log
        arcs: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]  # from, its forward sum plus weight, piece (-1: bytes)
        alpha = [0.0] * (n + 1)
        for i in range(n + 1):
            found = arcs[i]
            if len(found) == 1:
                alpha[i] = found[0][1]
            elif found:
                top = max([x for _, x, _ in found])
                alpha[i] = top + log(sum([exp(x - top) for _, x, _ in found]))
            a = alpha[i]
            for j in range(i + 1, n + 1):
                k = find(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    arcs[j].append((i, a + weights[k], k))
            if i < n and find(s[i], -1) < 0:
                arcs[i + 1].append((i, a + sum([weights[self.spell[b]] for b in s[i].encode("utf-8", "replace")]), -1))
        share = [0.0] * n + [1.0]  # posterior probability that a segmentation passes a position
        for j in range(n, 0, -1):
            passed = share[j]
            if passed:
                for i, x, k in arcs[j]:
                    p = passed * exp(x - alpha[j])
                    share[i] += p
                    if k >= 0:
                        into_counts[k] += p
                    else:
                        for b in s[i].encode("utf-8", "replace"):
                            into_counts[self.spell[b]] += p


def vocabulary(path: str = VOCABULARY) -> tuple[dict[str, int], list[int], np.ndarray]:
    """Pieces of a vocabulary file by number (those that do not reach over a word's start), numbers of the byte pieces, and first weights (probabilities)."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    rows = [(sp.id_to_piece(k), sp.get_score(k), sp.is_byte(k)) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    rows = [r for r in rows if r[2] or START not in r[0][1:]]
    rank = {name: k for k, (name, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], -r[1], r[0])))}
    pieces: dict[str, int] = {}
    spell = [0] * 256
    weights = np.zeros(len(rows))
    for k, (name, _, is_byte) in enumerate(rows):
        weights[k] = 1.0 / (rank[name] + 2.7)
        if is_byte:
            spell[int(name[3:5], 16)] = k
        else:
            pieces[name] = k
    return pieces, spell, weights / weights.sum()


def word_counts(documents: DataFrame) -> DataFrame:
    """word, n of all words of ``documents`` (train, text): n counts the rows to train on, and is 0 for words that those lack. A task counts before it passes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter[bytes] = Counter()
        for rest, texts in text_batches(batches):
            for train, text in zip(rest["train"], texts, strict=True):
                words = words_of(text)
                held.update(words if train else dict.fromkeys(words, 0))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return documents.select("train", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR) -> Lattice:
    """The lattice after ``rounds`` of expectation maximisation over the words of the table of counts, each counted once."""
    pieces, spell, first = vocabulary(path)
    sc = counts.sparkSession.sparkContext
    lattice = Lattice(pieces, spell, first, 0.2)
    for _ in range(rounds):
        shipped = sc.broadcast(lattice)  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            found, n = [0.0] * len(model.weights), 0
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    model.expect(word, found)
                n += batch.num_rows
            found = np.array(found)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*found[at].tolist(), float(n)])], ["piece", "n"])

        sums = dict(counts.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect())  # at most the vocabulary
        used = prior * first
        for k, n in sums.items():
            if k >= 0:
                used[k] += n
        lattice = Lattice(pieces, spell, used, sums.get(-1, 0.0) + 0.2 * prior)
        shipped.destroy()
    return lattice


def piece_scores(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """word, n, p: every different word's marginal log probability over the pieces, computed once."""
    shipped = counts.sparkSession.sparkContext.broadcast(lattice)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            p = [model.word(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(p, pa.float64())], ["word", "n", "p"])

    return counts.select("word", "n").mapInArrow(run, "word string, n long, p double")


def _log_sum(x: float, y: float) -> float:
    top = max(x, y)
    return top + math.log(math.exp(x - top) + math.exp(y - top))


class Scorer:
    """What a task needs for a document: counts and log probabilities of the head's words, and the end's."""

    def __init__(self, head: dict[bytes, tuple[int, float]], divisor: float, n_end: int, n: int, different: int):
        self.divisor, self.n_end, self.n = divisor, n_end, n
        self.share = math.log((DISCOUNT * different + 1) / (n + 1))  # of the pieces
        self.head = {w: (self.base(c), self.whole(p, c)) for w, (c, p) in head.items()}

    def base(self, count: int) -> float:
        return math.log10((count + 0.1) / self.divisor)

    def whole(self, pieces: float, count: int) -> float:
        """Log probability of a word from that of its pieces and its count: the arc over the whole word joins the sum."""
        p = self.share + pieces
        return _log_sum(p, math.log((count - DISCOUNT) / (self.n + 1))) if count else p

    def score(self, text: str) -> tuple[int, int, float, float, list[bytes], list[int]]:
        """Tokens; known tokens, base score and log score of the end and head words; the other words with their numbers."""
        found, find = Counter(words_of(text)), self.head.get
        tokens, known, base = 1, int(self.n_end > 0), self.base(self.n_end)
        others: list[bytes] = []
        times: list[int] = []
        score = math.log(self.n_end / (self.n + 1)) if self.n_end else 0.0
        for w, n in found.items():
            tokens += n
            told = find(w)
            if told is None:
                others.append(w)
                times.append(n)
            else:
                known += n
                base += n * told[0]
                score += n * told[1]
        return tokens, known, base, score, others, times


def score(documents: DataFrame, path: str = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    train = F.coalesce(fold("doc_id", 10) != 0, F.lit(False))
    counts = stored(word_counts(rows.select(train.alias("train"), "text")), "word-counts")
    n_texts = rows.filter(train).count()
    known = counts.filter(F.col("n") > 0)
    n_words, different = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n_words + n_texts, different + (n_texts > 0)
    divisor = n + 0.1 * (v + 1)
    words = stored(piece_scores(counts, estimate(known, path)), "word-scores")
    frequent = {r["word"].encode(): (r["n"], r["p"]) for r in words.filter((F.col("n") > 0) & (F.octet_length("word") <= HEAD_BYTES)).orderBy(F.desc("n"), "word").limit(head).collect()}
    scorer = documents.sparkSession.sparkContext.broadcast((shared := Scorer(frequent, divisor, n_texts, n, different)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key = scorer.value, TaskContext.get().partitionId() << 40
        for ids, texts in text_batches(batches):
            found = [s.score(t) for t in texts]
            tokens, known, base, score, others, times = list(zip(*found, strict=True)) or [()] * 6
            ends = pa.array(np.cumsum([0, *map(len, times)]), pa.int32())
            rest = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(others)), pa.binary()), pa.array(list(chain.from_iterable(times)), pa.int32())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(range(key, key + len(texts)), pa.int64()), pa.array(ids["doc_id"], pa.int64()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(ends, rest)], ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"])
            key += len(texts)

    # the key of a row is settled by writing it
    scored = stored(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,n:int>>"), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").cast("string").alias("word"), F.col("r.n").alias("times"))
    told = rest.join(words.withColumnRenamed("n", "c"), "word")
    pieces = F.col("p") + F.lit(shared.share)
    arc = F.log((F.greatest(F.col("c"), F.lit(1)) - F.lit(DISCOUNT)) / F.lit(n + 1.0))
    top = F.greatest(pieces, arc)
    word = F.when(F.col("c") > 0, top + F.log(F.exp(pieces - top) + F.exp(arc - top))).otherwise(pieces)
    sums = told.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((F.col("c") + F.lit(0.1)) / F.lit(divisor))).alias("more_base"), F.sum(F.col("times") * word).alias("more_score"))
    whole = scored.drop("rest").join(sums, "row", "left")
    return whole.select("doc_id", F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), ((F.col("score") + F.coalesce("more_score", F.lit(0.0))) / F.lit(LOG10)).alias("score"))
