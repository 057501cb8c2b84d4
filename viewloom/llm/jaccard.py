"""N-gram Jaccard join through parity sketches.

A document is the set of its distinct 5-word shingles. Shingle hashes are XORed into the blocks of a
sketch, so blocks in which two sketches differ are at most as many as the shingles in which the sets
differ. At similarity 0.8 two sets of a and b shingles differ in at most (a + b) / 9. Pigeonhole: if a
document is found under its first d + 1 non-empty blocks, in one order common to all documents,
every document within distance d shares one of them. Sketch and d belong to a size band; a document
near a band's upper edge is also found in the next one.

Steps: (1) equal sets become one class; (2) block keys of class representatives meet in buckets;
(3) each member is verified against the bucket leader with which it shares most keys; (4) in buckets
that still hold several components, members outside the largest one are compared with all others by bit
sketches inside a task, whose Hamming distance bounds the set difference from below, and the
surviving pairs are verified; (5) components.
No bucket's pairs are emitted, none is dropped, and every link between components is found.

The order of blocks puts frequent shingles last, by a count sketch of fixed size over all documents.
Order only moves work: any order common to all documents gives the same result.

Defined results: null or empty text, or text without words, has an empty set and is linked with nothing;
fewer than 5 words are one shingle; rows that share a doc_id are one node, null ids are nodes of
their own with a null component; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, released
from .components import components

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hash bits of a shingle; the others of a word hold a document's place in its batch.
BITS = 56
#: Shingles per block for the largest sets of a band. Fuller blocks agree by chance less often.
LOAD = 3
#: Counters of the frequency sketch.
COUNTERS = 1 << 18
#: Rows of 8 bytes that may be broadcast; beyond, texts are joined by shuffling.
BROADCAST_ROWS = 500_000
#: A member is compared with a leader first if they share one of STRONG of its keys.
STRONG = 3
#: Members per task of one leader, and documents of one bucket block.
FAN, BLOCK = 2000, 4096
#: Pairs of documents, and bytes of their sketches, that a task compares at once.
_PAIRS, _PAIR_BYTES = 1 << 18, 1 << 24

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_CHUNK_BYTES, _CHUNK_ROWS = 8 << 20, 1 << (64 - BITS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of up to _CHUNK_ROWS texts: sorted words (place << BITS | hash), and each text's number."""
    lists = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    w = np.fromiter((xxhash.xxh64_intdigest(x) for ws in lists for x in ws), np.uint64, int(n.sum()))
    doc, edge = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    h = np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(w))):
            h[: len(w) - k] = h[: len(w) - k] * _A + mix(w[k:] + np.uint64(k))
        place = np.arange(len(w)) - edge[doc]
        whole = place + SHINGLE <= n[doc]
        for d in np.flatnonzero((n > 0) & (n < SHINGLE)):  # a short text is one shingle of its own length
            own = np.uint64(n[d])
            for x in w[edge[d] : edge[d] + n[d]]:
                own = own * _A + x
            h[edge[d]], whole[edge[d]] = own, True
        h = mix(h) >> np.uint64(64 - BITS)
    key = np.sort((doc[whole].astype(np.uint64) << np.uint64(BITS)) | h[whole])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key, np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(texts))


def band(n: np.ndarray) -> np.ndarray:
    """Sizes in [2**b, 2**(b + 1)) are band b."""
    return np.frexp(np.maximum(n, 1).astype(float))[1].astype(np.int64) - 1


def blocks(cell: np.ndarray) -> np.ndarray:
    """Blocks of a band's sketch: always many more than are needed to have d + 1 filled ones.

    Small bands get more, since there d + 1 is nearly their size; the odds of too few are below 1e-8.
    """
    top = 2 ** (cell + 1)
    return np.where(top <= 32, 64 * top, np.where(top <= 128, top, top // LOAD))


def signatures(key: np.ndarray, n: np.ndarray, cell: np.ndarray, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Block keys under which each text is found in its ``cell`` (-1: none), and their number.

    A key's upper bits are the block's frequency level, then how few shingles it holds, so that sorting puts
    rare and full blocks first; both depend on the block alone.
    """
    mask = np.uint64((1 << BITS) - 1)
    doc = (key >> np.uint64(BITS)).astype(np.int64)
    use = cell[doc] >= 0
    key, doc = key[use], doc[use]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    h = key & mask
    block = ((h >> np.uint64(BITS - 32)) * blocks(np.maximum(cell, 0))[doc].astype(np.uint64)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])]))
    few = 7 - np.minimum(7, np.diff(np.concatenate([start, [len(h)]])))
    with np.errstate(over="ignore"):
        value = np.bitwise_xor.reduceat(mix(h + _A), start)
        value = mix(value + mix(block[start] + _B) + cell[doc[start]].astype(np.uint64)) >> np.uint64(64 - BITS + 7)
    value |= few.astype(np.uint64) << np.uint64(BITS - 7)
    if level is not None:
        at = np.minimum.reduceat(level[(h >> np.uint64(BITS - COUNTERS.bit_length() + 1)).astype(np.int64)], start)
        value |= at.astype(np.uint64) << np.uint64(BITS - 4)
    found = np.sort((doc[start].astype(np.uint64) << np.uint64(BITS)) | value)
    fdoc = (found >> np.uint64(BITS)).astype(np.int64)
    count = np.bincount(fdoc, minlength=len(n))
    rank = np.arange(len(found)) - (np.cumsum(count) - count)[fdoc]
    largest = np.minimum(100 * n // PERCENT, 2 ** (np.maximum(cell, 0) + 1) - 1)
    differ = (n + largest) * (100 - PERCENT) // (100 + PERCENT)
    take = rank <= differ[fdoc]
    return (found[take] & mask).astype(np.int64), np.bincount(fdoc[take], minlength=len(n))


def _chunks(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    texts = pc.fill_null(b.column(column), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK_BYTES
    cuts = sorted({0, len(texts), *(np.flatnonzero(np.diff(size)) + 1).tolist(), *range(0, len(texts), _CHUNK_ROWS)})
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def frequency_levels(docs: DataFrame, text: str = "text") -> np.ndarray:
    """A level from 0 (usual) to 15 for each of COUNTERS hash ranges, by how far it exceeds the mean count.

    Each task counts all its shingles and sends those ranges that stand out; they are at most COUNTERS / 4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.int64)
        for b in released(batches):
            for _, texts in _chunks(b, "_text"):
                key, _ = shingles(texts)
                h = (key & np.uint64((1 << BITS) - 1)) >> np.uint64(BITS - COUNTERS.bit_length() + 1)
                count += np.bincount(h.astype(np.int64), minlength=COUNTERS)
        out = np.flatnonzero(count > 8 + 4 * count.mean())
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(count[out]), pa.array(np.full(len(out), count.mean()))], ["range", "n", "mean"])

    counted = docs.select(F.col(text).alias("_text")).mapInArrow(run, "range long, n long, mean double")
    high = counted.groupBy("range").agg(F.sum("n").alias("n"), F.sum("mean").alias("mean")).select("range", F.floor(F.log2(F.col("n") / F.greatest("mean", F.lit(1.0)))).cast("int").alias("level"))
    level = np.zeros(COUNTERS, np.uint8)
    for r in high.where("level > 0").collect():  # at most COUNTERS rows, whatever the corpus
        level[r["range"]] = min(15, r["level"])
    return level


def sketch(h: np.ndarray) -> bytes:
    """Parity of the shingles of each low-bit class, as packed bits; as many classes as the power of two above their number."""
    size = max(8, 1 << int(len(h)).bit_length())
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def features(docs: DataFrame, level: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, h1, h2, sketch, keys): set size, 128-bit hash of the set, bit sketch, block keys of all cells."""
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            for lo, texts in _chunks(b, "_text"):
                sets, n = shingles(texts)
                some = np.flatnonzero(n)
                bits = [sketch(x) for x in np.split(sets & np.uint64((1 << BITS) - 1), np.cumsum(n)[:-1])]
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    start = (np.cumsum(n) - n)[some]
                    h = sets & np.uint64((1 << BITS) - 1)
                    with np.errstate(over="ignore"):
                        h1[some], h2[some] = np.bitwise_xor.reduceat(mix(h + _B), start), np.add.reduceat(mix(h * _A + np.uint64(1)), start)
                own = np.where(n > 0, band(n), -1)
                above = np.where((n > 0) & (100 * n // PERCENT >= 2 ** (own + 1)), own + 1, -1)
                parts = [signatures(sets, n, c, sent.value) for c in (own, above)]
                # per text, the keys of both cells one after the other
                text = np.concatenate([np.repeat(np.arange(len(n)), m) for _, m in parts])
                keys = np.concatenate([k for k, _ in parts])[np.argsort(text, kind="stable")]
                edge = np.concatenate([[0], np.cumsum(parts[0][1] + parts[1][1])])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, len(n)), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(keys))],
                    ["id", "n", "h1", "h2", "sketch", "keys"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(run, "id long, n long, h1 long, h2 long, sketch binary, keys array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """(k, id, lead) of the keys that several ids have, each id once a key; streams over partitions sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # of the last key so far: the leader alone, or nothing once it is out
        last_lead = last = None
        for b in batches:
            if not b.num_rows:
                continue
            k, i = (b.column(c).to_numpy() for c in ("k", "id"))
            new = np.concatenate([[(k[0], i[0]) != last], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])
            last = (k[-1], i[-1])
            k, i = k[new], i[new]
            k, i = np.concatenate([held[0], k]), np.concatenate([held[1], i])
            if not len(k):
                continue
            first = np.concatenate([[True], k[1:] != k[:-1]])
            begin = np.flatnonzero(first)
            lead = i[begin][np.cumsum(first) - 1]
            if last_lead is not None and k[0] == last_lead[0]:
                lead = np.where(k == k[0], last_lead[1], lead)
            size = np.diff(np.concatenate([begin, [len(k)]]))
            several = np.repeat(size > 1, size)
            if last_lead is not None:
                several |= k == last_lead[0]
            if several[-1]:
                last_lead, held = (k[-1], lead[-1]), (k[:0], i[:0])
            else:
                last_lead, held = None, (k[-1:], i[-1:])
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[several]), pa.array(i[several]), pa.array(lead[several])], ["k", "id", "lead"])

    return rows.repartition("k").sortWithinPartitions("k", "id").mapInArrow(run, "k long, id long, lead long")


def _few(rows: DataFrame, written: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined to a written table, which is broadcast only where it has few rows."""
    return rows.join(F.broadcast(written) if written.count() <= BROADCAST_ROWS else written.hint("merge"), on, how)


def _with_texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the listed ids, beside the columns of ``ids``; broadcast only where the list is short."""
    return _few(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")), ids, ["id"], "inner")


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from a larger one: classes that agree in the lower bits are XORed."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each row's other columns with its set as binary."""
    for b in released(batches):
        for lo, texts in _chunks(b, "_text"):
            key, n = shingles(texts)
            parts = np.split(key & np.uint64((1 << BITS) - 1), np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, len(n)) for c in names), pa.array([p.tobytes() for p in parts], pa.binary())], [*names, "set"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify_leaders(docs: DataFrame, best: DataFrame, key: str, text: str) -> DataFrame:
    """Linked (u, v) of members (id, lead); a leader's members are dealt FAN to a task, each with the leader's set."""
    fan = best.groupBy("lead").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    members = best.join(fan, "lead").select("id", "lead", F.pmod(F.xxhash64("id"), F.col("fan")).cast("int").alias("part"), F.lit(1).alias("role"))
    leaders = fan.select(F.col("lead").alias("id"), "lead", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = materialize(members.unionByName(leaders), "wanted")
    names = ["id", "lead", "part", "role"]
    sets = _with_texts(docs, wanted, key, text).select(*names, "_text").mapInArrow(lambda it: _sets(it, names), "id long, lead long, part int, role int, set binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in (*names, "set")}
            u, v = [], []
            for i, lead, part, role, raw in zip(*c.values(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (lead, part) != at:
                    at, mine = (lead, part), []
                if role == 0:
                    mine.append(s)  # more than one only where ids repeat
                elif any(linked(s, m) for m in mine):
                    u.append(i)
                    v.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    out = materialize(sets.repartition("lead", "part").sortWithinPartitions("lead", "part", "role").mapInArrow(run, "u long, v long"), "led")
    forget(wanted)
    return out


def _near(size: np.ndarray, bits: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much each pair's sketches differ beyond what a linked pair of their sizes may; at most 0 is allowed."""
    excess = np.empty(len(x), np.int64)
    small = np.minimum(size[x], size[y])
    for z in np.unique(small):
        at = np.flatnonzero(small == z)
        rows, back = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
        table = np.stack([_fold(bits[r], z) for r in rows])
        a, b = back[: len(at)], back[len(at) :]
        step = max(1, _PAIR_BYTES // z)
        for lo in range(0, len(at), step):
            part = slice(lo, lo + step)
            excess[at[part]] = np.bitwise_count(table[a[part]] ^ table[b[part]]).sum(axis=1, dtype=np.int64)
    return excess - (n[x] + n[y]) * (100 - PERCENT) // (100 + PERCENT)


def _candidates(start: np.ndarray, stop: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare of groups [start, stop), of which rows of role 1 come first: each of these with all rows
    after it. They come in portions of about _PAIRS."""
    first = np.concatenate([[0], np.cumsum(role)])
    queries = first[stop] - first[start]
    x = np.repeat(start - (np.cumsum(queries) - queries), queries) + np.arange(queries.sum())
    count = np.repeat(stop, queries) - x - 1
    edge = np.concatenate([[0], np.cumsum(count)])
    cuts = np.unique(np.searchsorted(edge, np.arange(0, edge[-1] + _PAIRS, _PAIRS)).clip(0, len(x)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = count[lo:hi]
        xs = np.repeat(x[lo:hi], n)
        yield xs, xs + 1 + np.arange(len(xs)) - np.repeat(np.cumsum(n) - n, n)


def _least(found: list[np.ndarray]) -> np.ndarray:
    """Of rows (k, component, component, excess, x, y, more) the least of each (k, component, component)."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[[5, 4, 3, 2, 1, 0]])]
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
    begin = np.flatnonzero(new)
    out = rows[begin]
    # another pair of these components in this bucket, be it here or in what was left out before
    other = np.concatenate([[False], ~new[1:] & (rows[1:, 4:6] != rows[:-1, 4:6]).any(axis=1)])
    out[:, 6] = np.maximum.reduceat(rows[:, 6] | other, begin)
    return out


def _across(rows: DataFrame, best_only: bool) -> DataFrame:
    """(k, x, y, more) of pairs in one bucket but different components that their bit sketches allow.

    ``rows`` has (k, id, c, n, sketch) and, of the bucket, its size and how many rows are outside its largest
    component. Only these are compared with all others: a bucket of more than BLOCK rows is cut into
    blocks of both, and what is copied grows with the rows outside the largest component. With
    ``best_only``, of each bucket and pair of components only the closest pair, and ``more`` if there are others.
    """

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        key = t.select(["k", "p", "q"]).combine_chunks()
        order = np.lexsort([-t["role"].to_numpy(), *(key[c].to_numpy() for c in ("q", "p", "k"))])
        t = t.take(pa.array(order))
        k, p, q, role, ids, comp, n = (t[c].to_numpy() for c in ("k", "p", "q", "role", "id", "c", "n"))
        bits = [np.frombuffer(x, np.uint8) for x in t["sketch"].to_pylist()]
        size = np.array([len(x) for x in bits])
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        start = np.flatnonzero(new)
        found = []
        for x, y in _candidates(start, np.append(start[1:], len(k)), role):
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            excess = _near(size, bits, n, x, y)
            x, y, excess = x[excess <= 0], y[excess <= 0], excess[excess <= 0]
            if len(x):
                u, v = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                found.append(np.stack([k[x], np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y]), excess, u, v, np.zeros(len(x), np.int64)], axis=1))
                if best_only and sum(map(len, found)) > _PAIRS:
                    found = [_least(found)]
        if not found:
            return None
        out = _least(found) if best_only else np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 4]), pa.array(out[:, 5]), pa.array(out[:, 6] > 0)], ["k", "x", "y", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in released(batches):
            if not b.num_rows:
                continue
            group = [b.column(c).to_numpy() for c in ("k", "p", "q")]
            change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in group])) + 1
            begins = not held or any(x[0] != held[-1].column(c)[-1].as_py() for x, c in zip(group, ("k", "p", "q"), strict=True))
            if len(change) or begins:  # the last group of the batch may go on
                whole = int(change[-1]) if len(change) else 0
                if (ready := [*held, b.slice(0, whole)]) and (out := compare(pa.Table.from_batches(ready, b.schema))) is not None:
                    yield out
                held = [b.slice(whole)]
            else:
                held.append(b)
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    large = F.col("size") > BLOCK
    outer = F.col("c") != F.col("main")
    parts, others = F.when(large, F.ceil(F.col("size") / BLOCK)).otherwise(1), F.when(large, F.ceil(F.col("rest") / BLOCK)).otherwise(1)
    hashed = F.xxhash64("id", F.lit(2))
    inner = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda q: F.struct(F.pmod(hashed, F.col("parts")).cast("int").alias("p"), q.alias("q"), F.lit(0).alias("role")))
    query = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("p"), F.pmod(hashed, F.col("others")).cast("int").alias("q"), F.lit(1).alias("role")))
    dealt = rows.withColumns({"parts": parts.cast("int"), "others": others.cast("int"), "outer": outer})
    # a row of the largest component, or of a large bucket, is compared with; a row outside compares itself
    role = F.when(~F.col("outer"), inner).when(F.col("parts") > 1, F.concat(inner, query)).otherwise(query)
    dealt = dealt.withColumn("d", F.explode(role)).select("k", "d.p", "d.q", "d.role", "id", "c", "n", "sketch")
    return dealt.repartition("k", "p", "q").sortWithinPartitions("k", "p", "q").mapInArrow(run, "k long, x long, y long, more boolean")


def _verify_pairs(docs: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (u, v) that are linked; only their texts are read into sets."""
    ids = materialize(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct(), "ids")
    sets = materialize(_with_texts(docs, ids, key, text).select("id", "_text").mapInArrow(lambda it: _sets(it, ["id"]), "id long, set binary"), "sets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [linked(np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint64)) for a, c in zip(b["a"], b["b"], strict=True)]
            yield b.loc[ok, ["u", "v"]]

    a = sets.select(F.col("id").alias("x"), F.col("set").alias("a"))
    c = sets.select(F.col("id").alias("y"), F.col("set").alias("b"))
    out = pairs.join(a, "x").join(c, "y").select(F.col("x").alias("u"), F.col("y").alias("v"), "a", "b").mapInPandas(run, "u long, v long")
    out = materialize(out, "linked")
    forget(ids, sets)
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (id, component) with further links (u, v), which are few: only components are searched anew."""
    of = lambda c: links.select(c, "other").join(comp, F.col(c) == F.col("id"), "left").select(F.coalesce("component", c).alias(c), "other")
    links = links.select("u", F.col("v").alias("other"))
    links = of("u").select(F.col("other").alias("v"), F.col("u").alias("other"))
    links = of("v").select(F.col("other").alias("u"), "v")
    roots = materialize(components(links), "roots")
    moved = comp.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return materialize(moved.unionByName(roots.join(comp, "id", "left_anti")), "components")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component) of every row."""
    feats = materialize(features(docs, frequency_levels(docs, text), key, text), "features")
    some = feats.where("n > 0 and id is not null")
    # of each set that several rows have one represents it; rows that share an id or a set are links already
    groups = some.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").select("h1", "h2", "rep")
    groups = materialize(groups, "groups")
    copies = materialize(_few(some.select("id", "h1", "h2"), groups, ["h1", "h2"], "inner").where("id != rep").distinct(), "copies")
    links = copies.select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = _few(some, copies.select("id", "h1", "h2"), ["id", "h1", "h2"], "left_anti")
    shared = materialize(_shared(reps.select("id", F.explode("keys").alias("k"))), "shared")
    # most links by comparing each member with the leader that it shares most with, where that is much
    met = shared.where("id != lead").groupBy("id", "lead").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max("n").alias("n"), F.max_by("lead", F.struct("n", -F.col("lead"))).alias("lead"))
    strong = best.join(feats.select("id", F.size("keys").alias("m")), "id").where(STRONG * F.col("n") >= F.col("m")).select("id", "lead").distinct()
    strong = materialize(strong, "strong")
    if not strong.isEmpty():
        links = links.unionByName(_verify_leaders(docs, strong, key, text))
    comp = materialize(components(links), "components")
    # all other links between components
    sketches = feats.select("id", "n", "sketch")
    buckets = None
    for best_only in () if shared.isEmpty() else (True, False):
        at = shared if buckets is None else shared.join(buckets, "k", "left_semi")
        at = materialize(_few(at.select("k", "id"), comp, ["id"], "left").select("k", "id", F.coalesce("component", "id").alias("c")), "at")
        # of buckets with the same members one will do
        who = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
        mixed = at.groupBy("k").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"), *who).where("c0 != c1").groupBy("size", "x0", "x1").agg(F.min("k").alias("k"), F.min("c0").alias("c0"))
        mixed = materialize(mixed.select("k", "size", "c0"), "mixed")
        dealt = mixed.select("k", "size", F.col("c0").alias("main"), F.col("size").alias("rest"))
        if not mixed.where(F.col("size") > BLOCK).isEmpty():
            large = _few(at, mixed.where(F.col("size") > BLOCK).select("k"), ["k"], "left_semi").groupBy("k", "c").agg(F.count("*").alias("n"))
            main = large.groupBy("k").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"))
            dealt = mixed.join(main, "k", "left").select("k", "size", F.coalesce("main", "c0").alias("main"), (F.col("size") - F.coalesce("most", F.lit(0))).alias("rest"))
            dealt = materialize(dealt, "dealt")
        found = materialize(_across(_few(at, dealt, ["k"], "inner").join(sketches, "id"), best_only), "pairs")
        forget(at, mixed, dealt)
        if found.isEmpty():
            break
        comp = _merged(comp, _verify_pairs(docs, found.select("x", "y").distinct(), key, text))
        buckets = found.where("more").select("k").distinct()
        if not best_only or buckets.isEmpty():
            break
    forget(shared, groups, copies, strong)
    own = feats.select("id", "n")
    return _few(own, comp, ["id"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def report(docs: DataFrame) -> DataFrame:
    return similar(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component; rows without a set stay."""
    found = similar(docs).where("id != component").select(F.col("id").alias("doc_id")).distinct()
    return _few(docs, materialize(found, "later"), ["doc_id"], "left_anti").select(*docs.columns)
