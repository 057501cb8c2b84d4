"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences; a sentence of more than LONG words counts as several, cut where a hash of
the words around is least, so that equal stretches are cut alike wherever they begin. At every sentence
the run of SPAN sentences that begins there is hashed by its lower-case words; where it has fewer than LEAST
words, the shortest longer runs that begin and that end there and reach LEAST are; a text of fewer words is one
run. A run that occurs more than once in the corpus, also within one document, keeps its first occurrence, by
(doc_id, place), and the sentences of all others are removed. Of a passage that overlaps itself so much stays
as it takes to hold each of its sentences once.

A shared passage of over 50 words is found whole where it begins and ends at sentences. Of one that begins
or ends inside a sentence of more than LONG words the parts between common cuts are found; a piece has LEAST / 2
to LONG words, so of such a passage with fewer than three common cuts nothing may be found.

Defined results: null text stays null without sentences; texts of one sentence are left alone; repeated
rows of one document count as one; extra columns are kept by ``dedup``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import materialize, released
from .spans import covered_places, identified, later_occurrences

SPAN, LEAST, LONG = 2, 16, 25
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)\s*|\n\s*|[.!?]+|$)")
_WORD = re.compile(r"\S+\s*")
#: Words of a long sentence's piece at least, so that two pieces have LEAST.
_PIECE = LEAST // 2
#: A place is the run's first sentence << _BITS | its sentences, which are LEAST at most.
_BITS = 5
NEW = {"new": pa.string(), "n_sentences": pa.int64(), "n_removed": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32())}


def sentences(text: str) -> list[str]:
    """The text cut into sentences that join to it again; white space goes with what it follows."""
    out: list[str] = []
    held = ""
    for m in _SENTENCE.finditer(text):
        s = m.group()
        if not s:
            continue
        held += s
        if s[-1].isspace() or m.end() == len(text):
            out.append(held)
            held = ""
    if held:
        out.append(held)
    cut: list[str] = []
    for s in out:
        if len(s) < 2 * LONG or len(s.split()) <= LONG:
            cut.append(s)
            continue
        lead = s[: len(s) - len(s.lstrip())]
        w = _WORD.findall(s)
        edges = [0, *_cuts(w), len(w)]
        parts = ["".join(w[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        parts[0] = lead + parts[0]
        cut += parts
    return cut


def _cuts(w: list[str]) -> list[int]:
    """Where a long sentence is cut: at hashes of two neighbouring words that are the least of _PIECE - 1 on
    either side, and then in stretches of more than LONG words at the least within reach of the last cut."""
    words = [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in "".join(w).lower().split()]
    h = [0, *[((y + x * 0x9E3779B1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 16 for x, y in zip(words, words[1:], strict=False)]]
    r, i, least = _PIECE - 1, _PIECE, []
    while i < len(h) - r:
        right = h[i + 1 : i + r + 1]
        m = min(right)
        if h[i] >= m:
            i += 1 + right.index(m)
            continue
        if h[i] <= min(h[i - r : i]):
            least.append(i)
        i += r + 1
    out, at = [], 0
    for c in [*least, len(w)]:
        while c - at > LONG:
            reach = h[at + _PIECE : at + LONG - _PIECE + 1]
            at += _PIECE + reach.index(min(reach))
            out.append(at)
        if c < len(w):
            out.append(c)
        at = c
    return out


def runs(text: str) -> tuple[int, list[int], list[int], list[int]]:
    """The number of sentences, and two hashes and the place of each run; sentences without words are skipped."""
    cut = sentences(text)
    said = [w for s in cut if (w := s.lower().split())]
    edge = [0, *accumulate(map(len, said))]
    joined = [" ".join(w) for w in said]
    found = []
    for j in range(len(said) - SPAN + 1):
        if edge[j + SPAN] - edge[j] >= LEAST:
            found.append((j, j + SPAN))
            continue
        end, begin = bisect_left(edge, edge[j] + LEAST), bisect_right(edge, edge[j + SPAN] - LEAST) - 1
        if end < len(edge):
            found.append((j, end))
        if begin >= 0:
            found.append((begin, j + SPAN))
    if not found and len(said) >= SPAN:
        found.append((0, len(said)))
    h1, h2, pos = [], [], []
    for i, j in dict.fromkeys(found):
        d = xxhash.xxh3_128_intdigest("\n".join(joined[i:j]).encode("utf-8", "surrogatepass"))
        h1.append(d >> 64)
        h2.append(d & 0xFFFFFFFFFFFFFFFF)
        pos.append(i << _BITS | j - i)
    return len(cut), h1, h2, pos


#: What one text is cut into: its sentences, and the hashes and places of its runs.
CUT = pa.schema([("id", pa.int64()), ("tx", pa.int64()), ("n_sentences", pa.int64()), ("runs", pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32())])))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in released(batches):
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            h1, h2, pos, n, edge = [], [], [], [], [0]
            for t in part.column("text").to_pylist():
                count, a, c, p = runs(t or "")
                h1 += a
                h2 += c
                pos += p
                n.append(count)
                edge.append(len(pos))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            each = pa.StructArray.from_arrays([signed(h1), signed(h2), pa.array(pos, pa.int32())], ["h1", "h2", "pos"])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tx"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), each)], schema=CUT)


def _removed(text: str, places: list[int]) -> tuple[list[int], list[int], str]:
    """(character offsets of each removed stretch, the text without them)."""
    cut = sentences(text)
    solid = [i for i, s in enumerate(cut) if s.strip()]
    gone = sorted({solid[(p >> _BITS) + k] for p in places for k in range(p & (1 << _BITS) - 1)})
    edge = np.concatenate([[0], np.cumsum([len(s) for s in cut])])
    starts = [int(edge[g]) for j, g in enumerate(gone) if j == 0 or gone[j - 1] != g - 1]
    ends = [int(edge[g + 1]) for j, g in enumerate(gone) if j == len(gone) - 1 or gone[j + 1] != g + 1]
    lost = set(gone)
    return starts, ends, "".join(s for i, s in enumerate(cut) if i not in lost)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text deduplicated, ``n_sentences``, ``n_removed`` (characters) and the removed
    stretches as ``starts`` and ``ends`` in the original text; these replace columns of their names.

    Each text is cut once, and the hashes of its runs are written; texts that lose something are cut again
    where it is removed.
    """
    named = identified(docs, key, text)
    cut = materialize(named.select("id", "tx", F.col("row")[text].alias("text")).mapInArrow(_cut, from_arrow_schema(CUT)), "cut")
    found = cut.select("id", "tx", F.explode("runs").alias("r")).select("r.h1", "r.h2", "id", "tx", "r.pos")
    places = covered_places(later_occurrences(found))
    known = cut.groupBy("id", "tx").agg(F.max("n_sentences").alias("n_sentences")).join(places, ["id", "tx"], "left")
    joined = named.join(known, ["id", "tx"]).select("row", "n_sentences", "places")
    schema = StructType([joined.schema["row"], *(StructField(n, from_arrow_type(t)) for n, t in NEW.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            old = pc.struct_field(b.column("row"), text)
            rows = []
            for i, p in enumerate(b.column("places").to_pylist()):
                if p:
                    starts, ends, new = _removed(old[i].as_py(), p)
                    rows.append((new, sum(ends) - sum(starts), starts, ends))
                else:
                    rows.append((old[i].as_py(), 0, [], []))
            new, removed, starts, ends = zip(*rows, strict=True) if rows else [()] * 4
            found = {"new": new, "n_sentences": b.column("n_sentences"), "n_removed": removed, "starts": starts, "ends": ends}
            yield pa.RecordBatch.from_arrays([b.column("row"), *(c if isinstance(c, pa.Array) else pa.array(list(c), NEW[n]) for n, c in found.items())], ["row", *NEW])

    out = joined.mapInArrow(run, schema)
    kept = [F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in NEW]
    return out.select(*kept, *[c for c in NEW if c != "new"])


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))
