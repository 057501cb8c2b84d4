"""Benchmark decontamination with an Aho-Corasick automaton.

The windows of all benchmark items (13 consecutive normalised words, or the whole item if it has
fewer) form one automaton over word numbers. Each text is scanned once, in normalised form; matches are
word places, mapped to character offsets of the original text.

The benchmark is measured first. Up to BLOCK_BYTES of it make one automaton; a larger one is written in blocks
of that size, dealt by hash, and each block is a pass of its own over the documents. The driver sends a block's
texts; each Python worker builds the automaton, which takes some 100 MB for each MB of text.

Defined results: null or empty text has no words and is clean; items without words match nothing;
rows with equal item ids count as one item, null item ids as item "null"; repeated documents each get
their row; extra columns are kept whatever their names; texts of any length are scanned whole; empty tables
give clean or no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import forget, kept_in_worker, materialize, released

WINDOW = 13
BLOCK_BYTES = 2 << 20
#: Bytes of text whose results are held at once.
_CHUNK = 4 << 20
#: A word in a text before it is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words stay, A-Z in lower case; all others become spaces. Bytes from 0x80 are in words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Matcher:
    """The automaton of some items' windows. Words are numbered from 1; 0 stands for those of no window."""

    def __init__(self, items: list[tuple[str, str]]):
        import ahocorasick

        self.automaton, self.number = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in normal(text))
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                window = w[i : i + WINDOW]
                size, known = self.automaton.get(window, (len(window), ()))
                if item not in known:
                    self.automaton.add_word(window, (size, (*known, item)))
        if self.number:
            self.automaton.make_automaton()

    def match(self, text: str) -> tuple[int, np.ndarray, list[str]]:
        """(words, which words are hit, items with an occurring window)."""
        w = normal(text)
        hit, items = np.zeros(len(w), bool), set()
        if w and self.number:
            get = self.number.get
            for last, (size, found) in self.automaton.iter(tuple([get(x, 0) for x in w])):
                hit[last + 1 - size : last + 1] = True
                items.update(found)
        return len(w), hit, sorted(items)


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of each run of hit words."""
    if not hit.any():
        return []
    places = [m.span() for m in WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(places[a][0], places[b - 1][1]) for a, b in edge.reshape(-1, 2)]


MATCHED = {"n_words": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}


def _scanned(docs: DataFrame, items: list[tuple[str, str]], text: str, before: bool) -> DataFrame:
    """(row, found): ``found`` as MATCHED, with what ``before`` says is in it already."""
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    kind = pa.struct(list(MATCHED.items()))
    schema = StructType([docs.schema["row"], StructField("found", from_arrow_type(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = kept_in_worker(f"matcher {name}", lambda: Matcher(sent.value))
        for b in released(batches):
            rows = b.column("row")
            texts = pc.fill_null(pc.struct_field(rows, text), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(texts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                old = b.column("found").slice(lo, hi - lo).to_pylist() if before else [None] * (hi - lo)
                found = []
                for t, o in zip(texts.slice(lo, hi - lo).to_pylist(), old, strict=True):
                    n, hit, items = matcher.match(t)
                    if o:
                        hit[o["hits"]] = True
                        items = sorted({*items, *o["items"]})
                    at = spans(t, hit)
                    found.append({"n_words": n, "hits": np.flatnonzero(hit), "items": items, "starts": [x[0] for x in at], "ends": [x[1] for x in at]})
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), pa.array(found, kind)], ["row", "found"])

    return docs.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(how many follow, items) of each block; of several the items are read once and written by block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    if n > 1:
        written = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")), "blocks", by="block")
    for i in range(n):
        part = written.where(F.col("block") == i).select("item", "text") if n > 1 else items
        yield n - 1 - i, [tuple(r) for r in part.collect()]


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, found): each row of ``docs`` whole, and its ``n_words``, ``hits`` (places of hit words), ``items`` and
    the offsets ``starts`` and ``ends`` of the hit runs in the original text.

    One block of the benchmark is one scan without a shuffle. Of several, each is a pass of its own over the
    rows that the one before has written, so driver and tasks hold one block at a time.
    """
    out, written = docs.select(F.struct(*docs.columns).alias("row")), None
    for left, items in _blocks(benchmark, block_bytes):
        out = _scanned(out, items, text, written is not None)
        if left:
            last, written = written, materialize(out, "scanned")
            out = written
            if last is not None:
                forget(last)
    return out


def contaminated(n_hit, n_words):
    """The contract's rule: at least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    m = match(docs.select("doc_id", "text"), benchmark).select("row.doc_id", "found.*")
    n_hit = F.size("hits").cast("long")
    return m.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
        F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s.starts.cast("string"), s.ends.cast("string"))).alias("spans"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; nothing is shuffled."""
    return match(docs, benchmark).where(~contaminated(F.size("found.hits"), F.col("found.n_words"))).select("row.*")
