"""Secret scans over an incremental blob ledger.

Every text version is content-addressed. The ledger is a table of the scanned (blob, rule version) pairs with
their findings, also empty ones; a run scans only pairs that it lacks, each blob once however many paths
hold it, appends them, and joins stored and new findings back to all paths. Rows of a ledger do not depend on
each other, so after a run that broke off the next one scans what is missing.

Defined results: null text is the empty blob; equal texts share one scan; a blob without findings
gives an empty span list; repeated rows each get their findings; extra columns are ignored; an empty
table scans nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, stack


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    least: int = 0  # characters of the measured group
    group: int = 0
    flags: int = re.ASCII
    hints: tuple[str, ...] = ()  # lower-case strings, one of which any match contains


#: Base kinds first; spans at the same place are listed in this order.
KINDS = (
    Kind("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.ASCII | re.IGNORECASE, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Kind("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Kind("hex", r"[0-9a-f]{24,}", 24),
    Kind("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----begin",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Kind("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@", hints=("://",)),
)
BASE = ("assign", "access", "hex")
RULE_VERSION = "2024-1"
#: Copies' ids are broadcast up to this many rows of 8 bytes; beyond, the texts are joined by shuffling.
BROADCAST_ROWS = 500_000


def scan(text: str, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) of each span, in the order of the contract."""
    found, low = [], text.lower()
    for i, k in enumerate(kinds):
        if k.hints and not any(h in low for h in k.hints):
            continue
        for m in re.finditer(k.pattern, text, k.flags):
            if m.end(k.group) - m.start(k.group) >= k.least:
                found.append((m.start(), i, k.name, m.end()))
    return sorted(found)


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        spans = [scan(t) for t in stack(b["text"])]
        yield pd.DataFrame({
            "blob": b["blob"], "rule_version": RULE_VERSION,
            "kinds": [[x[2] for x in s] for s in spans], "starts": [[x[0] for x in s] for s in spans], "ends": [[x[3] for x in s] for s in spans],
        })


FOUND = "blob string, rule_version string, kinds array<string>, starts array<int>, ends array<int>"


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with ``blob``, the SHA-256 of the text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of the newly scanned blobs, all versions with their blobs).

    ``ledger`` has the (blob, rule_version) rows of earlier runs. Of each unseen blob the copy with the
    smallest key is scanned. The keys not to scan are broadcast only if they are few.
    """
    at = materialize(address(versions, text).select(key, "blob"), "blobs")
    first = at.groupBy("blob").agg(F.min(key).alias(key))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct(), "blob", "left_anti")
    skip = materialize(at.join(first.select(key), key, "left_anti").select(key).distinct(), "skip")
    few = skip.count() <= BROADCAST_ROWS
    todo = versions.select(key, F.col(text).alias("text")).join(F.broadcast(skip) if few else skip.hint("merge"), key, "left_anti")
    found = address(todo).select("blob", "text").mapInPandas(_scan_batches, FOUND)
    return found.dropDuplicates(["blob"]) if ledger is not None else found, at


def findings(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Spans of every document: stored and new findings of its blob joined back by content address."""
    found, at = scan_unseen(docs, ledger)
    found = materialize(found, "findings")
    return _joined_back(at, found if ledger is None else found.unionByName(ledger.select(*found.columns)))


def _joined_back(at: DataFrame, found: DataFrame) -> DataFrame:
    hit = found.where((F.col("rule_version") == RULE_VERSION) & (F.size("kinds") > 0))
    hit = hit.groupBy("blob").agg(F.first("kinds").alias("kinds"), F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    return at.join(hit, "blob", "left")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; without rows where nothing has been written."""
    try:
        return spark.read.schema(FOUND).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FOUND)


def run(docs: DataFrame, path: str) -> DataFrame:
    """``findings`` with the ledger at ``path``, to which the newly scanned blobs are appended first."""
    found, at = scan_unseen(docs, read_ledger(docs.sparkSession, path))
    ledger_entries(found).write.mode("append").option("compression", "zstd").parquet(path)
    return _joined_back(at, read_ledger(docs.sparkSession, path))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans; without a ``path`` from an empty ledger."""
    f = run(docs, path or f"{shared_dir(docs.sparkSession)}/viewloom-{uuid.uuid4().hex}/ledger")
    none = F.array().cast("array<string>")
    spans = F.coalesce(F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(s.kinds.alias("kind"), F.concat_ws(":", s.kinds, s.starts.cast("string"), s.ends.cast("string")).alias("span"))), F.array().cast("array<struct<kind:string,span:string>>"))
    f = f.select("doc_id", "blob", F.coalesce("kinds", none).alias("kinds"), spans.alias("s"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("s", lambda x: x.kind.isin(*BASE)), lambda x: x.span), ",")
    return f.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("s", lambda x: x.span), ",").alias("spans"), "blob",
    )


def ledger_entries(found: DataFrame) -> DataFrame:
    """What a run appends to the ledger: each pair once with its findings."""
    return found.dropDuplicates(["blob", "rule_version"])

