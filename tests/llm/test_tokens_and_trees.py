"""Alignment, manifest and packing against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakeframe.llm import alignment, merkle, packing
from tests.compare import DATA

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
CODES = [*b"ab z\n\t\r .,'s1", 0xBD, 0xE9, 0x301, 0x65E5, 0x3000, 0x2581, 0xA0, 0x85, 0x1C, 0x0B, 0x0C, 0x2003, 0x130, *b"<|>"]
CHARS = [*map(chr, CODES), "<|endoftext|>", "<s>", "  ", "\r\n", " 's", "'LL", "##.%"]


def odd_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    made = ["".join(rng.choice(CHARS) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    rows = [(None, None, "no id"), (1, "", "twice"), (1, " ", "twice"), (2, "\n", None), (3, "<|endoftext|> x </s><unk>", "s"), (4, "a▁b", "s"), (5, "word " * 30_000, "s"), (6, "x" * 9000, "s"), (1, "", "twice"), (7, "over\nlines\n", "s")]
    return rows + [(10 + k, t, f"s{k % 3}") for k, t in enumerate(made)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, None if i == 2 else "en", None if t is None else len(t), 1, "x") for i, t, s in odd_rows(300, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, row int, tree string")


# op11


def _plain_tokens(text, ta, sb, of_a, of_b):
    if not text:
        return None
    data, a, b = (" " + text).encode(), ta.encode(" " + text, add_special_tokens=False).ids, sb.encode(text)
    if b"".join(of_a[k] for k in a) != data or b"".join(of_b[k] for k in b) != data:
        return None
    spans = lambda ids, of: list(zip(np.cumsum([0] + [len(of[k]) for k in ids[:-1]]).tolist(), np.cumsum([len(of[k]) for k in ids]).tolist(), ids, strict=True))
    in_a, in_b = spans(a, of_a), spans(b, of_b)
    groups, links, j, low_a, low_b = [], [], 0, 0, 0
    ends_a = {z: k + 1 for k, (_, z, _) in enumerate(in_a)}
    for m, (_, z, _) in enumerate(in_b):
        if z in ends_a:
            groups.append(",".join(map(str, a[low_a : ends_a[z]])) + "|" + ",".join(map(str, b[low_b : m + 1])))
            low_a, low_b = ends_a[z], m + 1
    for s, z, k in in_a:
        while in_b[j][1] <= s:
            j += 1
        m = j
        while m < len(in_b) and in_b[m][0] < z:
            links.append((k, in_b[m][2]))
            m += 1
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def _plain_alignment(rows):
    ta, sb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    of_a, of_b = alignment._bytes_of_a(ta), alignment._bytes_of_b([sb.id_to_piece(k) for k in range(sb.get_piece_size())])
    found = [(i, _plain_tokens(t, ta, sb, of_a, of_b)) for i, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, *f[:3], len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for i, f in found]


@pytest.mark.parametrize("bucket", [1_000_000, 400])
def test_alignment_equals_a_plain_version(spark, odd, monkeypatch, bucket):
    """Whole texts encoded at once, all overlaps one by one; with small buckets the frequent ids have several."""
    monkeypatch.setattr(alignment, "BUCKET", bucket)
    got = [tuple(r) for r in alignment.align(odd, A, B).collect()]
    want = _plain_alignment([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 150


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").filter(F.length("text") < 1500)
    got = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    assert sorted(got) == sorted(_plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_alignment_when_few_units_are_known(monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 5)
    u = alignment.Units(A, B)
    texts = [t for _, t, _ in odd_rows(60, 8) if t]
    first = [list(u.of_texts([t]))[0] for t in texts]
    assert first == list(alignment.Units(A, B).of_texts(texts))


# op12


def _plain_manifest(rows):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    leaf = lambda r: h(*["-" if r[f] is None else f"{len(str(r[f]).encode())}:{r[f]}" for f in merkle.FIELDS])

    def tree(nodes):
        ways, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(k, min(k + 3, len(nodes))) for k in range(0, len(nodes), 3)]
            for run in runs:
                for k in run:
                    for x in under[k]:
                        ways[x].append(("".join(nodes[q] for q in run if q < k), "".join(nodes[q] for q in run if q > k)))
            nodes, under = [h(*[nodes[q] for q in run]) for run in runs], [[x for q in run for x in under[q]] for run in runs]
        return nodes[0], ways

    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    subs = [tree([leaf(r) for r in by[s]]) for s in order]
    root, tops = tree([s[0] for s in subs])
    out = []
    for s, (sub, ways), top in zip(order, subs, tops, strict=True):
        for r, way in zip(by[s], ways, strict=True):
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            x = leaf(changed)
            for left, right in way + top:
                x = h(left, x, right)
            out.append((r["doc_id"], leaf(r), sub, root, h(*[a + b for a, b in way + top]), x, x == root))
    return out


def test_manifest_equals_a_plain_version(spark, odd):
    got = [tuple(r) for r in merkle.digest(odd).collect()]
    assert sorted(got, key=str) == sorted(_plain_manifest([r.asDict() for r in odd.collect()]), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [2], [3], [729], [730], [729 * 3 + 1, 1, 4], [1] * 800])
def test_manifest_of_trees_of_any_height(spark, sizes):
    """Whole blocks, blocks and a rest, more sources than a block has nodes."""
    rows = [(1000 * s + k, f"t{k}\n", f"s{s}", None, 1) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    assert sorted(map(tuple, merkle.digest(docs).collect())) == sorted(_plain_manifest([r.asDict() for r in docs.collect()]))


# op13


def _check_packing(rows, got):
    """Every id in one piece, checksums, and gapless sequences; returns padding over tokens."""
    tokenizer = Tokenizer.from_file(W)
    want = Counter()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["start"]].append(r)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for start in range(0, len(ids), packing.LENGTH):
            piece = ids[start : start + packing.LENGTH]
            want[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert want == Counter(tuple(r[:5]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert 0 < at <= packing.LENGTH
        total += at
        padding += packing.LENGTH - at if at & (at - 1) else 0
    return padding / total


def test_packing_of_odd_rows(spark, odd):
    got = packing.digest(odd, W).collect()
    assert _check_packing([(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()], got) < 0.15
    assert packing.digest(odd.limit(0), W).count() == 0


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").repartition(6)
    assert _check_packing([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], packing.digest(docs, W).collect()) < 0.01


def test_words_give_the_tokenizers_ids(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 50)
    words, tokenizer = packing.WordIds(W), Tokenizer.from_file(W)
    texts = [t for _, t, _ in odd_rows(400, 5) if t]
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.of_texts(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_demand(seed):
    """Every class has room, no sequence is over its length, the program is at its bound and rounding adds a sequence for each class at most."""
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 100), 12, replace=False))
    demand = rng.integers(1, 400, 12)
    plan = packing.patterns(sizes, demand, 100)
    assert all(row @ sizes <= 100 for _, row in plan)
    assert (sum(n * row for n, row in plan) >= demand).all()
    program = packing._Program(sizes, demand, 100)
    rows, amount = program.solve(packing.GAP, packing.PIVOTS)
    assert (amount @ rows >= demand - 1e-6).all()
    price, best = program.cost @ program.inverse, [0.0] * 101
    for c in range(1, 101):
        best[c] = max([best[c - 1], *[best[c - s] + price[k] for k, s in enumerate(sizes) if s <= c]])
    bound = max(price @ demand / max(best[-1], 1), np.ceil(sizes @ demand / 100) / (1 + packing.GAP))
    assert price.min() > -1e-6 and amount.sum() <= bound * (1 + packing.GAP) + 1e-6
    assert sum(n for n, _ in plan) <= amount.sum() + len(sizes)


def test_places_of_ranks():
    classes = np.array([2, 5])
    plan = [(3, np.array([2, 1])), (1, np.array([0, 4]))]
    keys, runs, sequences = packing._places(plan, classes)
    assert sequences == 4 and keys.tolist() == [[2, 0], [5, 0], [5, 3]] and runs.tolist() == [[3, 0, 0], [3, 0, 2], [1, 3, 0]]


def test_empty_tables(spark, odd):
    assert alignment.align(odd.limit(0), A, B).count() == 0
    assert merkle.digest(odd.limit(0)).count() == 0
