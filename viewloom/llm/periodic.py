"""Periodic runs of words: stretches that repeat themselves at a distance.

A run has a smallest period q, is at least twice as long (and LEAST words), and cannot be extended with that
period. Blocks of 2^k words at multiples of 2^k are searched for across the document with an Aho-Corasick
automaton over word numbers. Any 2B - 1 consecutive words hold an aligned block of B words, so a run of
period q shows as a block that occurs again q words later, for any B with 2B - 1 <= q: of each scale, distances
from 2B - 1 to 4B - 2 count. Below 15, the least length lets blocks of four words find all periods but 6, which
blocks of two find. Each such pair of places is extended in both directions as far as words q apart agree.

Many documents are searched as one sequence in which no word number occurs in two documents. A block enters
an automaton only if each of its words comes again within the scale's reach. A block in a known run whose
period it holds is searched from that run's last period on: before, it occurs at multiples of the period alone.

Defined results: null and empty texts have no words and no runs; ties between equal stretches go to the smallest
period; texts of any length are searched whole, by automata of bounded size; repeated rows are treated
each; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import chunks, released, words

LEAST = 12
#: Bytes of text searched as one sequence, and words of the blocks in one automaton.
CHUNK_BYTES, AUTOMATON_WORDS = 2 << 20, 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(words of a block, least and greatest distance) for documents of at most ``longest`` words."""
    if longest >= LEAST:
        yield 4, 1, 14
        yield 2, 6, 6
    block = 8
    while 2 * (2 * block - 1) <= longest:
        yield block, 2 * block - 1, 4 * block - 2
        block *= 2


def _next_distance(w: np.ndarray) -> np.ndarray:
    """How far on each number comes again; the sequence's length where it does not."""
    order = np.argsort(w, kind="stable")
    out = np.full(len(w), len(w) + 1)
    same = w[order[1:]] == w[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(w: np.ndarray, starts: np.ndarray, begins: np.ndarray, block: int, near: int, far: int) -> Iterator[tuple[int, int]]:
    """(distance, start) of each aligned block of ``starts`` that occurs again ``near`` to ``far`` words later, from its ``begins`` on."""
    import ahocorasick

    step = max(1, AUTOMATON_WORDS // block)
    for lo in range(0, len(starts), step):
        at: dict[tuple, list[int]] = {}
        for s in starts[lo : lo + step].tolist():
            at.setdefault(tuple(w[s : s + block].tolist()), []).append(s)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in at.items():
            automaton.add_word(key, places)
        automaton.make_automaton()
        reach = sorted(zip(begins[lo : lo + step].tolist(), (starts[lo : lo + step] + far + block).tolist(), strict=True))
        i = 0
        while i < len(reach):  # blocks whose reaches overlap are searched in one go
            begin, end = reach[i]
            while i < len(reach) and reach[i][0] <= end:
                end = max(end, reach[i][1])
                i += 1
            for last, places in automaton.iter(tuple(w[begin:end].tolist())):
                o = begin + last - block + 1
                for s in places[bisect_left(places, o - far) : bisect_right(places, o - near)]:
                    yield o - s, s


def _right(w: np.ndarray, x: int, d: int) -> int:
    """The first place from ``x`` on whose word differs from the one ``d`` later."""
    end, step = len(w) - d, 32
    while x < end:
        differ = w[x : min(x + step, end)] != w[x + d : min(x + step, end) + d]
        k = int(differ.argmax())
        if differ[k]:
            return x + k
        x, step = x + len(differ), 2 * step
    return end


def _left(w: np.ndarray, x: int, d: int) -> int:
    """The first of the places that end before ``x`` and whose words all equal the ones ``d`` later."""
    step = 32
    while x > 0:
        lo = max(0, x - step)
        differ = (w[lo:x] != w[lo + d : x + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return x - k
        x, step = lo, 2 * step
    return 0


def find_runs(w: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers below 2^32, by start and period."""
    n = len(w)
    known: dict[tuple[int, int], int] = {}  # (start, end) and the smallest period
    listed: list[tuple[int, int]] = []  # end and period of the runs that ``inside`` points to
    inside = np.full(n, -1, np.int32)  # a run that holds the place
    again = _next_distance(w) if n >= LEAST else None
    for block, near, far in scales(n if longest is None else longest):
        starts = np.flatnonzero(again[: n - n % block].reshape(-1, block).max(axis=1) <= far) * block
        begins = starts + near
        if listed and len(starts):
            # inside a run whose period the block holds it occurs at multiples of that alone; the next place to find it begins after the run's last period
            ends, periods = np.array(listed).T
            r = inside[starts]
            begins = np.where((r >= 0) & (periods[r] <= block), np.maximum(begins, ends[r] - periods[r] + 1), begins)
            open_ = (begins <= starts + far) & (begins + block <= n)
            starts, begins = starts[open_], begins[open_]
        last = (0, 0, 0)  # distance and places of the latest agreement
        for d, s in sorted(_seeds(w, starts, begins, block, near, far)):
            if last[0] == d and last[1] <= s < last[2]:
                continue
            if (r := inside[s]) >= 0 and listed[r][0] >= s + d + block and d % listed[r][1] == 0:
                continue
            lo, hi = _left(w, s, d), _right(w, s + block, d)
            last = (d, lo, hi)
            if hi + d - lo >= max(LEAST, 2 * d) and known.get((lo, hi + d), d + 1) > d:
                known[lo, hi + d] = d
                inside[lo : hi + d] = len(listed)
                listed.append((hi + d, d))
    return sorted((lo, hi - lo, d) for (lo, hi), d in known.items())


def _numbers(lists: list[list[bytes]]) -> np.ndarray:
    """The words of all documents as numbers that no two documents share."""
    known: dict[bytes, int] = {}
    give = known.setdefault
    code = np.fromiter((give(x, len(known)) for y in lists for x in y), np.int64, sum(map(len, lists)))
    code += np.repeat(np.arange(len(lists)), [len(y) for y in lists]) * len(known)
    return np.unique(code, return_inverse=True)[1].astype(np.int64)


def search(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """The runs of each text and the text, words joined by one space, without what repeats a run's first period."""
    lists = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    found = find_runs(_numbers(lists), int(np.diff(edge).max(initial=0)))
    of = np.searchsorted(edge, [r[0] for r in found], "right") - 1
    per: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for i, (s, n, q) in zip(of.tolist(), found, strict=True):
        per[i].append((s - int(edge[i]), n, q))
    for w, runs in zip(lists, per, strict=True):
        if runs:
            keep = np.ones(len(w), bool)
            for s, n, q in runs:
                keep[s + q : s + n] = False
            w = [w[i] for i in np.flatnonzero(keep).tolist()]
        yield runs, b" ".join(w).decode("utf-8", "surrogatepass")


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, runs, collapsed): each row of ``docs`` whole, its runs, and its text without their repetitions. Nothing is shuffled."""
    given = docs.select(F.struct(*docs.columns).alias("row"))
    kind = pa.list_(RUN)
    schema = StructType([given.schema["row"], StructField("runs", from_arrow_type(kind)), StructField("collapsed", from_arrow_type(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            rows = b.column("row")
            texts = pc.fill_null(pc.struct_field(rows, text), "")
            for lo, hi in chunks(texts, CHUNK_BYTES):
                runs, kept = zip(*search(texts.slice(lo, hi - lo).to_pylist()), strict=True)
                told = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind)
                yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), told, pa.array(kept, pa.string())], ["row", "runs", "collapsed"])

    return given.mapInArrow(run, schema)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): one document in ten made periodic from some word on, as the checksum of its id says; null ids stay as they are."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_w")
    split = docs.select(key, text, h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, words(F.col(text))).alias("_w"))
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    placed = split.select("*", F.when(n > 0, a).cast("int").alias("_a"), F.when(n > 0, p).cast("int").alias("_p"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_w", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return placed.select(key, F.when((F.col("_h") % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col(text)).alias(text))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest, and digests of all runs and of the collapsed text."""
    told = repeats(planted(docs)).select("row.doc_id", "runs", "collapsed")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    found = told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), "runs", "collapsed")
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.select(
        "doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"),
        F.floor(-1000 * F.col("b.l") / F.col("b.p")).alias("exponent_milli"), _hash(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), _hash(F.col("collapsed")).alias("collapsed_sha256"),
    )
