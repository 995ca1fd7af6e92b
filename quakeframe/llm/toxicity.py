"""Toxic spans and scores from a linear-chain conditional random field.

The field has two labels (clean, toxic) over the tokens (runs of letters) of each sentence. Its training labels come
from document labels: words and word beginnings that set toxic documents apart are picked one by one, each for the
toxic documents that no picked one explains yet, and mark the tokens of toxic documents. Features of a token are its
word, its beginnings of four to eight letters (as far as the vocabulary has them), its last three letters, its length
and its capitals. The field is fitted by gradient ascent on the
conditional likelihood. Forward-backward marginals then give each token's probability; their sum, maximum and share
go into a logistic score, calibrated on the document labels, and tokens over one half are the offending spans.

The field is fitted on a bounded sample of labelled documents (``SAMPLE`` of each label, those of the smallest id
hashes, of at most ``SAMPLE_CHARS`` characters; copies of a text count once); every text is scored whole.

Defined results: null and empty texts, and texts without a letter, have no tokens and get the score of none; rows
repeated with one id each get a row; where labels repeat or disagree for an id, the largest counts and null labels
are left out; without a document of either label the score is 0.5 times the share of toxic labels (0 without any);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import fold, letters_in, stored, text_batches

SAMPLE = 2000
SAMPLE_CHARS = 20_000
#: Vocabulary and chains of the field; rounds of its fit.
VOCABULARY = 8000
CHAINS = 5000
CHAIN = 24
ROUNDS = 60
THRESHOLD = 0.7
SENTENCE = re.compile(r"[.!?\n]")


@dataclass
class Field:
    """Parameters of the field (those of toxic against clean) and of the document score."""

    weight: dict[str, float] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def emission(self, token: str) -> float:
        return sum(self.weight.get(f, 0.0) for f in features(token))


def stems(word: str) -> list[str]:
    """A word and its proper beginnings of four to eight letters."""
    return [word + "$", *[word[:k] for k in range(4, min(len(word), 9))]]


def features(token: str) -> list[str]:
    """All features of a token; the field knows those of its vocabulary."""
    low = token.lower()
    return [*stems(low), "-" + low[-3:], f"#{min(len(low), 12)}", *(["^"] if token[0].isupper() else []), ""]


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature, 0) >> 1


def pick(words: list[set[str]], toxic: list[int], least: int = 3, most: int = 300) -> set[str]:
    """Words and beginnings that explain toxic documents, the best in turn, counted over the documents without a picked one.

    Best is the largest gain: unexplained toxic documents that have it, less ten times what its share of clean ones
    would make there. Features are held as numbers; only those that can be picked at all are kept.
    """
    each = [np.unique(np.fromiter((_hash(f) for w in d for f in stems(w)), dtype=np.int64)) for d in words]
    y = np.array(toxic, dtype=bool)
    n_toxic, scale = int(y.sum()), 10 * y.sum() / max(len(y) - y.sum(), 1)
    ids = np.concatenate(each) if each else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(each)), [len(e) for e in each])
    del each
    names, at = np.unique(ids, return_inverse=True)
    penalty = scale * np.bincount(at[~y[doc]], minlength=len(names))
    counts = np.bincount(at[y[doc]], minlength=len(names))
    floor = max(least, 0.002 * n_toxic)
    telling = counts - penalty >= max(10, 0.04 * n_toxic)
    able = (counts - penalty >= floor)[at] & y[doc]
    at, doc = at[able], doc[able]
    found = np.zeros(len(names), dtype=bool)
    for _ in range(most):
        gain = np.bincount(at, minlength=len(names)) - penalty
        best = int(np.argmax(gain)) if len(gain) else 0
        if not len(at) or gain[best] < floor:
            break
        found[best] = True
        explained = np.isin(doc, doc[at == best])
        at, doc = at[~explained], doc[~explained]
    # others that the picked ones cover: as telling, and frequent
    wanted = set(names[found | telling].tolist())
    return {f for d, t in zip(words, toxic, strict=True) if t for w in d for f in stems(w) if _hash(f) in wanted}


def _chains(rows: list[tuple[str, int]], picked: set[str], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """At most CHAINS random chains of CHAIN tokens, half of them with a toxic token where there are enough."""
    cache: dict[str, bool] = {}
    kept: tuple[list, list] = ([], [])
    for text, y in rows:
        letters = letters_in(text)
        for s in SENTENCE.split(text):
            tokens = letters.findall(s)
            for k in range(0, len(tokens), CHAIN):
                piece = tokens[k : k + CHAIN]
                labels = []
                for w in piece:
                    low = w.lower()
                    if low not in cache:
                        cache[low] = not picked.isdisjoint(stems(low))
                    labels.append(int(bool(y) and cache[low]))
                heap = kept[any(labels)]
                entry = (rng.random(), piece, labels)
                if len(heap) < CHAINS:
                    heapq.heappush(heap, entry)
                elif entry[0] > heap[0][0]:
                    heapq.heapreplace(heap, entry)
    cold, hot = (sorted(h, reverse=True) for h in kept)
    hot = hot[: CHAINS // 2]
    return [(p, y) for _, p, y in hot + cold[: CHAINS - len(hot)]]


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Field:
    """Fit the field and the document score on (text, label) rows."""
    rows = sorted(dict(rows).items())
    out = Field()
    toxic = [y for _, y in rows]
    if not sum(toxic) or sum(toxic) == len(rows):
        out.constant = 0.5 * sum(toxic) / max(len(rows), 1)
        return out
    picked = pick([{w.lower() for w in letters_in(t).findall(t)} for t, _ in rows], toxic)
    rng = np.random.default_rng(seed)
    chains = _chains(rows, picked, rng)

    counts = Counter(f for s, _ in chains for w in s for f in features(w))
    kept = sorted(picked | {f for f, n in counts.most_common(VOCABULARY) if n > 2})
    at = {f: k for k, f in enumerate(kept)}
    none, size, width = len(kept), len(kept) + 1, 10
    length = max(len(s) for s, _ in chains)
    feats = np.full((len(chains), length, width), none, dtype=np.int32)
    gold = np.zeros((len(chains), length), dtype=np.int64)
    mask = np.zeros((len(chains), length), dtype=bool)
    for k, (s, y) in enumerate(chains):
        for j, w in enumerate(s):
            own = [at[f] for f in features(w) if f in at]
            feats[k, j, : len(own)] = own[:width]
        gold[k, : len(y)] = y
        mask[k, : len(y)] = True
    theta, step = np.zeros(size), np.zeros((2, 2))
    grad_mean, grad_square = [np.zeros(size), np.zeros((2, 2))], [np.zeros(size), np.zeros((2, 2))]
    pairs = mask[:, 1:]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for turn in range(1, ROUNDS + 1):
        theta[none] = 0.0
        e = np.stack([np.zeros(feats.shape[:2]), theta[feats].sum(axis=2)], axis=2)
        forward, backward, total = _chain_sums(e, step, mask)
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
        error = np.where(mask, gold - p, 0.0)
        g = np.bincount(feats.reshape(-1), np.repeat(error.reshape(-1), width), minlength=size) - 0.02 * theta
        both = forward[:, :-1, :, None] + step + (e + backward)[:, 1:, None, :] - total[:, None, None, None]
        h = gold_pairs - np.exp(both[pairs]).sum(axis=0) - 0.02 * step
        for k, (x, grad) in enumerate(((theta, g), (step, h))):  # Adam
            grad_mean[k] = 0.9 * grad_mean[k] + 0.1 * grad
            grad_square[k] = 0.99 * grad_square[k] + 0.01 * grad**2
            x += 0.15 * (grad_mean[k] / (1 - 0.9**turn)) / (np.sqrt(grad_square[k] / (1 - 0.99**turn)) + 1e-8)
    out.weight = {f: float(theta[k]) for f, k in at.items() if abs(theta[k]) > 1e-4}
    out.step = step

    cache: dict[str, float] = {}
    x = np.array([summary(m) for k in range(0, len(rows), 200) for m in marginals(out, [t for t, _ in rows[k : k + 200]], cache)])
    y = np.array([v for _, v in rows], dtype=float)
    w = np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-1 * np.eye(4), x.T @ (y - p) - 1e-1 * w)
    out.score = w
    return out


def _chain_sums(e: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward sums (without, for the backward ones, the own emission) of padded chains, and their totals."""
    n, length, _ = e.shape
    forward, backward = np.zeros_like(e), np.zeros_like(e)
    forward[:, 0] = e[:, 0]
    for t in range(1, length):
        on = mask[:, t, None]
        forward[:, t] = np.where(on, np.logaddexp(forward[:, t - 1, 0, None] + step[0], forward[:, t - 1, 1, None] + step[1]) + e[:, t], forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        on = mask[:, t + 1, None]
        later = e[:, t + 1] + backward[:, t + 1]
        backward[:, t] = np.where(on, np.logaddexp(later[:, 0, None] + step[:, 0], later[:, 1, None] + step[:, 1]), 0.0)
    return forward, backward, np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])


def marginals(model: Field, texts: list[str], cache: dict[str, float] | None = None) -> list[np.ndarray]:
    """For each text the probability of each of its tokens to be toxic.

    The chains of all texts run side by side, the longest first, so that step t works on those with more than t tokens.
    """
    cache = {} if cache is None else cache
    emission = model.emission
    values: list[float] = []
    lengths: list[int] = []
    counts = []
    for text in texts:
        n, letters = len(values), letters_in(text)
        for s in SENTENCE.split(text):
            tokens = letters.findall(s)
            if tokens:
                for w in tokens:
                    v = cache.get(w)
                    if v is None:
                        v = cache[w] = emission(w)
                    values.append(v)
                lengths.append(len(tokens))
        counts.append(len(values) - n)
    if len(cache) > 300_000:
        cache.clear()
    e = np.array(values)
    if len(e):
        size = np.array(lengths)
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains with more than t tokens
        a, b = np.exp(model.step[:, 1] - model.step[:, 0])  # odds of toxic after clean and after toxic
        ratio = math.exp(model.step[1, 0] - model.step[0, 0])
        forward, backward = np.empty(len(e)), np.zeros(len(e))
        r = np.clip(e[start], -40, 40)  # log odds of toxic given what came so far
        forward[start] = r
        for t in range(1, len(alive)):
            n = alive[t]
            odds = np.exp(r[:n])
            r = np.clip(e[start[:n] + t] + np.log((a + b * ratio * odds) / (1 + ratio * odds)), -40, 40)
            forward[start[:n] + t] = r
        # backwards: log odds of toxic from what comes later
        up, down = math.exp(model.step[1, 0] - model.step[0, 0]), np.exp(model.step[:, 1] - model.step[:, 0])
        for t in range(len(alive) - 2, -1, -1):
            n = alive[t + 1]
            odds = np.exp(np.clip(e[start[:n] + t + 1] + backward[start[:n] + t + 1], -40, 40))
            backward[start[:n] + t] = np.log(up * (1 + down[1] * odds) / (1 + down[0] * odds))
        e = 1 / (1 + np.exp(-np.clip(forward + backward, -40, 40)))
    return np.split(e, np.cumsum(counts)[:-1])


def summary(p: np.ndarray) -> np.ndarray:
    """What the document score looks at: a constant, the largest marginal, and the sum and the share of toxic tokens on a log scale."""
    if not len(p):
        return np.array([1.0, 0.0, 0.0, 0.0])
    total = float(p.sum())
    return np.array([1.0, float(p.max()), math.log1p(total), math.log1p(100 * total / len(p))])


def sampled(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic: the bounded sample of labelled documents outside the held-out fold, at most 2 x ``most`` texts of SAMPLE_CHARS characters, in one ordered partition.

    Labels meet the documents by id and a hash of the text; of each label the ``most`` of the smallest hashes are taken, and only their texts are fetched.
    """
    known = labels.filter((fold("doc_id", 3) != 1) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = documents.select(F.col("doc_id").cast("long"), "text").filter(F.length("text").between(1, SAMPLE_CHARS)).withColumn("key", F.xxhash64("doc_id", "text"))
    able = stored(rows.select("doc_id", "key").join(known, "doc_id"), "toxic-labelled")
    order = (F.xxhash64("doc_id", F.lit(42)), "doc_id", "key")
    ids = None
    for label in (0, 1):
        top = able.filter(F.col("toxic") == label).orderBy(*order).limit(most)
        ids = top if ids is None else ids.union(top)
    chosen = F.broadcast(stored(ids.distinct(), "toxic-sample"))  # 2 x ``most`` rows of three numbers
    found = stored(rows.join(chosen, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")), "toxic-texts")
    return found.repartition(1).sortWithinPartitions("toxic", *order).select("text", "toxic")


def sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """The rows of ``sampled`` on the driver."""
    return [tuple(r) for r in sampled(documents, labels, most).collect()]


def score(documents: DataFrame, model: Field, spans: bool = False) -> DataFrame:
    """doc_id and score of every row; with ``spans`` the offending code point ranges too."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_, cache = shipped.value, {}
        for rest, texts in text_batches(batches):
            scores, found = score_texts(field_, texts, cache)
            cols = [pa.array(rest["doc_id"], pa.int64()), pa.array(scores, pa.float64())]
            if spans:
                cols.append(pa.array([offsets(t, p) for t, p in zip(texts, found, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "spans"][: len(cols)])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double" + ", spans array<struct<start:int,end:int>>" * spans)


def keep_clean(documents: DataFrame, model: Field) -> DataFrame:
    """The rows of ``documents`` whose score is under THRESHOLD, all columns as they are."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            scores = []
            for _, texts in text_batches([batch.select(["text"])]):
                scores += score_texts(shipped.value, texts, cache)[0]
            yield batch.filter(pa.array([x < THRESHOLD for x in scores], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def score_texts(model: Field, texts: list[str], cache: dict[str, float]) -> tuple[list[float], list[np.ndarray]]:
    """Scores of texts, and the marginals of their tokens."""
    found = marginals(model, texts, cache)
    if model.constant is not None:
        return [model.constant] * len(texts), found
    return (1 / (1 + np.exp(-np.clip(np.array([summary(p) for p in found]).reshape(-1, 4) @ model.score, -30, 30)))).tolist(), found


def offsets(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Ranges of the tokens over one half, in code points, end exclusive."""
    if not (p > 0.5).any():
        return []
    return [{"start": m.start(), "end": m.end()} for m, q in zip(letters_in(text).finditer(text), p, strict=True) if q > 0.5]


def train(documents: DataFrame, labels: DataFrame) -> Field:
    """The field fitted on the sample, in a task: the driver gets its parameters, not the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["field"])

    fitted = sampled(documents, labels).mapInArrow(run, "field binary").first()
    return pickle.loads(fitted["field"]) if fitted else fit([])


def digest(scored: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
