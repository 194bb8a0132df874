"""Secret scans over a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table of (blob,
rule version) pairs that were scanned, with the spans found. A scan takes only pairs that are not in the
ledger, one version of each blob, appends what it finds, and joins the spans of all blobs back to every
path. New rules, or changed ones, are a new rule version, so they alone are run over old blobs.

Every blob leaves a map task once, however many copies the task reads, so a blob that makes up much of
the table does not gather in one place. Texts are shuffled once, for blobs that are not in the ledger.

Rows: a null text counts as empty; a row's id may be null or repeated (a path with several versions),
every row gets its spans; other columns of the input are carried through unread. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reelfold.llm.tables import in_batches

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; shorter ones (of ``group``) are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    base: bool = True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# a private key with its body: to the END line, else to the end of the header and base64 lines (line ends may
# be written as \n); a short last line counts after a long one
_PEM = (
    r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"
    r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr])++[A-Z][A-Za-z]*+-[A-Za-z]++:[^\n\\]*+)*+"
    r"(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})++"
    r"(?:(?:\s|\\[nr])++(?:[A-Za-z0-9+/]{4}){0,4}(?:[A-Za-z0-9+/]{2,4}=?=?)(?=[\s\\\"']|\Z))?)?)"
)

# tries start at the start of a run of the token's characters only (after a written line end as well), and no
# part gives back what it took, so long runs of "eyJ" take linear time
_JWT = (
    r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))"
    r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
)

#: The patterns and lengths that the base kinds are defined by, in their order, then the
#: kinds that this scanner adds.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8, group=2, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
    Rule("pem", _PEM, least=1, base=False),
    Rule("jwt", _JWT, least=1, base=False),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    found = []
    for n, (rule, pattern) in enumerate(compiled):
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), n, m.end(), rule.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of (blob, text); a blob that comes again in the same partition is left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        seen: set[str] = set()
        for batch in batches:
            batch = _unseen(batch, seen)
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, compiled)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind)], names=["blob", "spans"]
            )

    return blobs.select("blob", "text").transform(in_batches, scan, f"blob string, spans {SPANS}")


def _unseen(batch: pa.RecordBatch, seen: set[str]) -> pa.RecordBatch:
    """The rows whose blob is not in ``seen`` yet; adds them to it."""
    first = []
    for i, blob in enumerate(batch.column(0).to_pylist()):
        if blob not in seen:
            seen.add(blob)
            first.append(i)
    return batch if len(first) == batch.num_rows else batch.take(pa.array(first, pa.int64()))


def once_a_task(blobs: DataFrame) -> DataFrame:
    """(blob, text) with each blob once for every task that reads it, so that no copy is shuffled twice
    from one place; the addresses of a partition are all that is held."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            yield _unseen(batch, seen)

    return blobs.select("blob", "text").transform(in_batches, drop, "blob string, text string")


def _address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rule_version, spans) scanned so far; empty where nothing was written yet."""
    schema = f"blob string, rule_version string, spans {SPANS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def update_ledger(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks of ``docs``; (blob, spans) of all its blobs with spans.

    Scanning again costs the addresses and a join of them. A scan that failed half-way appends nothing
    (Spark's committer); one that is repeated after a commit finds its pairs in the ledger.
    """
    spark = docs.sparkSession
    version = rule_version(rules)
    blobs = docs.select(
        _address(F.col(text_col)).alias("blob"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    known = read_ledger(spark, ledger).filter(F.col("rule_version") == version)
    new = (
        once_a_task(blobs).repartition("blob")
        .join(known.select("blob").hint("shuffle_hash"), "blob", "left_anti")
    )
    scan_texts(new, rules).select("blob", F.lit(version).alias("rule_version"), "spans").write.mode(
        "append"
    ).parquet(ledger)
    return (
        read_ledger(spark, ledger)
        .filter((F.col("rule_version") == version) & (F.size("spans") > 0))
        .select("blob", "spans").dropDuplicates(["blob"])
    )


def _with_spans(docs: DataFrame, hits: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_blob`` and ``_spans``; Spark splits a blob of many copies, as both sides are
    shuffled for the join."""
    none = F.array().cast(SPANS)
    return (
        docs.withColumn("_blob", _address(F.col(text_col)))
        .join(hits.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "_blob", "left")
        .withColumn("_spans", F.coalesce("_spans", none))
    )


def scan_versions(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, blob, spans) for every row of ``docs``, by way of the ledger, which is brought up to date."""
    hits = update_ledger(docs, ledger, rules, text_col)
    return _with_spans(docs.select(id_col, text_col), hits, text_col).select(
        id_col, F.col("_blob").alias("blob"), F.col("_spans").alias("spans")
    )


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def counts(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and a hash of the base spans, and all spans written out."""
    base = [r.kind for r in rules if r.base]
    return found.select(
        "doc_id",
        *[counts(k).alias(f"n_{k}") for k in base],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def redact(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
    mark: str = "[{}]",
) -> DataFrame:
    """``docs`` with every span replaced by its kind; overlapping spans become one.

    ``n_chars``, where there is such a column, follows a text that changed; a null one is filled in.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for i, spans in enumerate(batch.column("_spans").to_pylist()):
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [texts[i][at : s["start"]], mark.format(s["kind"])]
                    at = max(at, s["end"])
                if out:
                    texts[i] = "".join(out) + texts[i][at:]
            place = batch.schema.get_field_index("_text")
            yield batch.set_column(place, "_text", pa.array(texts, pa.string())).drop_columns(["_spans"])

    rows = docs.withColumnRenamed(text_col, "_text")
    found = _with_spans(rows, update_ledger(docs, ledger, rules, text_col), "_text").drop("_blob")
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else None
    if n_chars is not None:
        n_chars = F.when(F.size("_spans") > 0, F.lit(None)).otherwise(n_chars)
        found = found.withColumn("n_chars", n_chars)
    clean = found.transform(in_batches, cut, rows.select(*[c for c in found.columns if c != "_spans"]).schema)
    clean = clean.withColumnRenamed("_text", text_col)
    if n_chars is not None:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce("n_chars", F.length(text_col).cast(kind)))
    return clean.select(*docs.columns)
