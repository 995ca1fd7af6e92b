"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every historical version of every path is content-addressed by the SHA-256 of its bytes. A blob is scanned once for
each rule version: the ledger holds, for every blob, the rule versions that it has been scanned with and the spans
they found, each with its rule version; a later call scans the pairs of blob and rule version that the ledger lacks
and appends them, and reads the contents of no other blob. Findings are joined back to all paths that ever held the
blob, so copies cost a hash and a join instead of a scan.

Defined results: a null text counts as empty and has no findings; repeated rows each get their own result row; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import columns_of, scratch, spread_join, stored

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
FOUND = "array<struct<rule:string,kind:string,start:int,end:int>>"
#: Elements that a fold appends to one array; appending copies it, so longer arrays are folded in pieces.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order that breaks ties of start.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),  # shorter runs fail whole, so the length can stand in the pattern
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further formats with a prefix that ordinary text does not have.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state before, element)`` for every element of an array, the state going on by ``step``; folded piece by piece, in time about linear."""
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], emit(acc["at"], x)).alias("out"))

    def outer(acc: Column, k: Column) -> Column:
        piece = F.aggregate(F.slice(values, k * PIECE + 1, F.lit(PIECE)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        # the transform binds the piece, which would else be folded for each use
        return F.get(F.transform(F.array(piece), lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out"))), F.lit(0))

    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / PIECE).cast("int") - 1, F.lit(0)))
    return F.flatten(F.aggregate(pieces, F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer)["out"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule, in code points, end exclusive.

    What lies between matches, from split(), and the matches themselves alternate; their running lengths are the offsets.
    """
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hit"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )

    def emit(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.when(x["part"] >= rule.least, F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), start.alias("start"), (start + x["hit"]).alias("end")))

    found = lambda p: running(p, F.lit(0), lambda at, x: at + x["gap"] + x["hit"], emit, "struct<rule:string,kind:string,start:int,end:int>")
    paired = F.filter(pairs, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(rule.pattern), F.filter(bound(paired, found), lambda x: x.isNotNull())).otherwise(F.array().cast(FOUND))


def joined(found: Column) -> Column:
    """kind:start:end of spans in the order of their start and kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class BlobLedger:
    """A table in ``path``: one row for each blob and scan, with the rule versions applied and the spans found.

    A scan is appended under Spark's commit protocol: a call that dies leaves no rows, and its blobs stay unseen.
    """

    SCHEMA = f"blob binary, rules array<string>, spans {FOUND}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        if _exists(self.spark, self.path):
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], self.SCHEMA)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the texts of ``versions`` with those rule versions that the ledger lacks for them."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        contents = versions.select(F.coalesce(F.col(text), F.lit("")).alias("content")).withColumn("blob", F.unhex(F.sha2("content", 256)))
        lacking = None
        if _exists(self.spark, self.path):
            # hashes first: only the contents of blobs with something left to scan are dealt out
            seen = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            blobs = contents.select("blob").distinct().join(seen, "blob", "left")
            lacking = blobs.select("blob", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).filter(F.size("rules") > 0)
            lacking = stored(lacking, "unseen-blobs")
            contents = spread_join(contents, lacking.select("blob"), "blob", "left_semi")
        # copies meet in the map side's first aggregation: a blob of a third of all rows is a row for each task
        todo = contents.groupBy("blob").agg(F.any_value("content").alias("content"))
        todo = todo.withColumn("rules", keys) if lacking is None else todo.join(lacking, "blob")
        found = [F.when(F.array_contains("rules", r.key), spans(F.col("content"), r)).otherwise(F.array().cast(FOUND)) for r in rules]
        todo.select("blob", "rules", F.concat(*found).alias("spans")).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, spans of the given rule versions, ranked in their order; blobs without any are left out."""
        def own(rule: Rule, rank: int) -> Column:
            found = F.transform(F.filter("spans", lambda s: s["rule"] == rule.key), lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["kind"], s["end"]))
            # a pair that was scanned twice found the same
            return F.coalesce(F.any_value(F.when(F.array_contains("rules", rule.key), found), ignoreNulls=F.lit(True)), F.array().cast(SPAN))

        hits = self.rows().filter(F.size("spans") > 0).groupBy("blob").agg(F.concat(*[own(r, k) for k, r in enumerate(rules)]).alias("spans"))
        return hits.filter(F.size("spans") > 0)

    def of_paths(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """All rows of ``versions`` as ``row``, with their blob and its spans, an empty array where none was found."""
        addressed = versions.select(F.struct(*columns_of(versions)).alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("blob"))
        held = spread_join(addressed, stored(self.findings(rules), "findings"), "blob")
        return held.select("row", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan_documents(documents: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan a table of doc_id and text; returns doc_id and spans for every row."""
    spark = documents.sparkSession
    ledger = BlobLedger(spark, ledger_path or scratch(spark, "ledger"))
    ledger.scan(documents.select("text"), rules=rules)
    return ledger.of_paths(documents.select("doc_id", "text"), rules=rules).select("row.doc_id", "spans")


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span of ``found`` replaced by ``mask``; spans that overlap get one mask.

    The text is first cut where a piece of the spans ends, and then within: a cut walks over what it cuts from.
    """
    kind = "struct<at:int,start:int,end:int>"
    follow = lambda at, s: F.greatest(at, s["end"])
    told = bound(F.array_sort(found), lambda sorted_: running(sorted_, F.lit(0), follow, lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), F.greatest(at, s["end"]).alias("end")), kind))

    def part(all_: Column, k: Column) -> Column:
        own = F.slice(all_, k * PIECE + 1, F.lit(PIECE))
        first, last = F.get(own, F.lit(0))["at"], F.element_at(own, -1)["end"]
        gap = lambda cut, s: F.concat(F.substring(cut, s["at"] - first + 1, s["start"] - s["at"]), F.lit(mask))
        return bound(F.substring(text, first + 1, last - first), lambda cut: F.array_join(F.transform(own, lambda s: F.when(s["start"] >= s["at"], gap(cut, s)).otherwise("")), ""))

    def whole(all_: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.ceil(F.size(all_) / PIECE).cast("int") - 1)
        tail = F.substring(text, F.element_at(all_, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(pieces, lambda k: part(all_, k)), ""), tail)

    return F.when(F.size(found) > 0, bound(told, whole)).otherwise(text)


def redact_documents(documents: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with every secret in the text masked, and n_chars (if there is one) as it is then; all rows and columns stay."""
    spark = documents.sparkSession
    ledger = BlobLedger(spark, ledger_path or scratch(spark, "ledger"))
    ledger.scan(documents.select("text"), rules=rules)
    held = ledger.of_paths(documents, rules=rules)
    held = held.withColumn("masked", redacted(F.col("row.text"), F.col("spans")))
    cols = []
    for f in documents.schema.fields:
        own = F.col("row").getField(f.name)
        if f.name == "text":
            own = F.col("masked")
        elif f.name == "n_chars":
            own = F.when(F.size("spans") > 0, F.length("masked").cast(f.dataType)).otherwise(own)
        cols.append(own.alias(f.name))
    return held.select(*cols)


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the query, from doc_id and spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
