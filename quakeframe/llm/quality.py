"""Quality rules with a bitmask ledger.

Every document is measured once and every rule is evaluated once; the ledger, a stored table, holds the measurements
and one long whose bit k says that rule k failed. Policies are versioned masks over those bits: applying another
policy, or asking what each rule costs (its ablation), reads the ledger and never the texts.

Defined results: a null text has no words; empty texts measure zero everywhere (and fail the rule on length); rows
repeated with one id each get a row; an empty table gives an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import stored, text_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measures) is true. Bits are never reused for another rule."""

    bit: int
    name: str
    fails: str


#: Whole numbers only, so that every engine gets the same bits.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "too_many_words", "n_words > 1000000"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "symbols", "10 * n_symbols > 3 * word_chars"),
    Rule(6, "repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines"),
)
#: Policies: name and version -> bits that reject a document.
POLICIES = {
    ("base", 1): 0b0000011,
    ("web", 1): 0b1111111,
    ("web", 2): 0b1110011,
}
BASE = ("base", 1)
PRODUCTION = ("web", 1)


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The measures of one text."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
        width = len(number)
        pairs = ids[:-1] * width + ids[1:]
        if width < 2_000_000:
            windows = pairs[:-1] * width + ids[2:]
        else:  # the product would not fit
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * np.int64(width) + ids[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            again = np.zeros(len(windows), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            inside = np.zeros(n, dtype=bool)
            for k in range(3):
                inside[k : k + len(again)] |= again
            repeated = int(inside.sum())
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines))


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, and fail_bits of every row: a stored table, from which all policies are answered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in text_batches(batches):
            found = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([pa.array(rest["doc_id"], pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in found.T]], ["doc_id", *MEASURES])

    measured = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return stored(measured.withColumn("fail_bits", bits), "quality-ledger")


def passes(policy: tuple[str, int] = PRODUCTION) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(rows: DataFrame, policy: tuple[str, int] = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that the policy without it would keep.

    The ledger is first counted by its bits: at most one row for each combination of rules, whatever the documents.
    """
    mask = POLICIES[policy]
    counted = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    used = [(r.bit, r.name, 1 << r.bit) for r in rules if mask >> r.bit & 1]
    each = counted.withColumn("r", F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule"), F.lit(m).cast("long").alias("mask")) for b, n, m in used]))).select("bits", "n", "r.*")
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    others = F.col("bits").bitwiseAND(F.bitwise_not("mask"))
    return each.groupBy("bit", "rule").agg(some(F.col("bits").bitwiseAND(F.col("mask")) != 0).alias("n_fail"), some((others == 0) & (F.col("bits") != 0)).alias("n_only"), some(others == 0).alias("n_kept_without"))


def report(rows: DataFrame, policies: tuple[tuple[str, int], ...] = tuple(POLICIES)) -> DataFrame:
    """The ablations of several policies over one ledger, with the bits that any and that all of its documents fail."""
    all_ = rows.agg(F.coalesce(F.bit_or("fail_bits"), F.lit(0).cast("long")).alias("any_bits"), F.coalesce(F.bit_and("fail_bits"), F.lit(0).cast("long")).alias("all_bits"))
    out = None
    for name, version in policies:
        one = ablation(rows, (name, version)).select(F.lit(name).alias("policy"), F.lit(version).alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(all_))  # one row


def digest(rows: DataFrame) -> DataFrame:
    """The result columns of the query."""
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(PRODUCTION).alias("kept"), "fail_bits")
