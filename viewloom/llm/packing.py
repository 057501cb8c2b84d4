"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the shape of an attention layer's work.
Within a group of documents, pieces in descending order go to the lowest-cost sequence that has room.
A piece that fits nowhere is cut to fill the sequence with the most room. Each group opens just
as many sequences as its tokens need, so the padding is below one sequence per group.

Documents are dealt to groups by a hash of their places in the table, so that equal rows are spread like others. A
group holds a bounded number of text bytes, whatever the size of the corpus, and documents longer than a
sequence are cut before they are dealt. A table should be given as it is read from files: its places must not change between attempts.

Defined results: null or empty text is the end token alone; repeated rows are packed each; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, released

SEQUENCE = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
#: UTF-8 bytes of text that one packing group holds on average.
GROUP_BYTES = 4 << 20
#: Bytes, about, of distinct words and their ids that a Python worker keeps.
CACHE_BYTES = 128 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

_FEW = [chr(i) for i in range(0x180)]
_LETTER, _NUMBER = ("".join(re.escape(c) for c in _FEW if unicodedata.category(c)[0] == k) for k in "LN")
#: The vocabulary's own word rule, written out for characters below U+0180.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
#: Texts with other characters, odd white space or an added token's mark go through the tokenizer whole.
_ODD = r"<\||[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{17f}]"
#: Bytes of text encoded at once.
_CHUNK = 4 << 20
#: Bytes that a known word takes beside its characters and ids.
_PER_WORD = 160


class WordEncoder:
    """Ids as the tokenizer gives them, computed once per distinct word.

    The vocabulary never joins across white space and ends each word with an id whose token ends in
    ``</w>``. So new words are encoded together and the ids are split after these.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # the same model behind a split at spaces, for pieces whose bytes are already written as the model's characters
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = "".join(chr(b if b in shown or b == 32 else 256 + hidden.index(b)) for b in range(256))
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = np.zeros(1 << 12, np.int64)
        self.starts = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, self.dtype)
        self.used = self.size = 0

    def _learn(self, new: list[str]) -> None:
        pieces = [_PIECE.findall(w) for w in new]
        flat = [p for x in pieces for p in x]
        line = codecs.charmap_decode(" ".join(flat).encode(), "strict", self.letters)[0]
        got = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids if flat else [], np.int64)
        last = np.flatnonzero(self.ends[got])
        assert len(last) == len(flat), "a word did not end where its ids do"
        edge = np.concatenate([[0], last + 1])[np.concatenate([[0], np.cumsum([len(x) for x in pieces])])]
        n = len(self.known)
        while n + len(new) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(got)] = got
        self.starts[n : n + len(new)] = self.used + edge[:-1]
        self.lengths[n : n + len(new)] = np.diff(edge)
        self.used += len(got)
        self.size += _PER_WORD * len(new) + sum(map(len, new)) + got.nbytes
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by ``end``; the number of each text's, with that."""
        if self.size > CACHE_BYTES:
            self.reset()
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~odd))))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 4096):
            self._learn(new[at : at + 4096])
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        n = self.lengths[at]
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.starts[at] - before[:-1], n) + np.arange(before[-1])]
        edge = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        others = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for t in texts.filter(pa.array(odd)).to_pylist()]
        count = np.zeros(len(texts), np.int64)
        count[~odd], count[odd] = np.diff(edge), [len(x) for x in others]
        starts = np.cumsum(count + 1) - count - 1
        out = np.full(len(ids) + sum(map(len, others)) + len(texts), end, self.dtype)
        out[np.arange(len(ids)) + np.repeat(starts[~odd] - edge[:-1], np.diff(edge))] = ids
        for s, x in zip(starts[odd], others, strict=True):
            out[s : s + len(x)] = x
        return out, count + 1


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, kept between tasks."""
    return kept_in_worker(f"encoder {path}", lambda: WordEncoder(path))


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Token ids of every document with the end token, cut into pieces of at most ``sequence`` ids.

    Columns: the key, ``start`` (ids before the piece), ``doc_tokens``, ``ids`` (little-endian binary), ``place`` (of the document).
    ``path`` defaults to the public vocabulary as installed on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary())
        for b in released(batches):
            texts = pc.fill_null(b.column("_text"), "")
            place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), len(texts)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                ids, totals = enc.encode(texts.slice(lo, hi - lo), END)
                n = -(-totals // sequence)
                row = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * sequence
                length = np.minimum(sequence, totals[row] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]) * enc.dtype.itemsize
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(totals[row]), data, b.column("place").slice(lo, hi - lo).take(pa.array(row))], [key, "start", "doc_tokens", "ids", "place"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("place")).mapInArrow(run, f"{key} {kind}, start long, doc_tokens long, ids binary, place long")


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def balance(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Places (piece, first id in it, ids, sequence) in the order in which each sequence is filled."""
    n = max(1, -(-int(lengths.sum()) // sequence))
    room, spent = np.full(n, sequence), np.zeros(n)
    out = []
    for p in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[p])
        while left:
            fits = np.where(room >= left, spent, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            take = min(left, int(room[s]))
            out.append((int(p), start, take, s))
            room[s] -= take
            spent[s] += cost(take)
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per packed piece, with its ids: ``sequence_id``, ``offset`` and ``ids`` rebuild the sequences."""
    weight = docs.select((F.coalesce(F.octet_length(text), F.lit(0)) + 64).alias("n")).agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(weight) // group_bytes))
    kind = docs.schema[key].dataType.simpleString()
    narrow = encoder(path or vocabulary()).dtype.itemsize == 2

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(key, "ascending"), ("start", "ascending")])
        ids = [np.frombuffer(x, "<u2" if narrow else "<u4") for x in group["ids"].to_pylist()]
        starts = group["start"].to_numpy()
        number = group["group"][0].as_py() << 32
        placed = balance(np.array([len(x) for x in ids], np.int64), sequence)
        p, first, n, s = (np.array(x, np.int64) for x in (zip(*placed, strict=True) if placed else [()] * 4))
        raw = [ids[i][f : f + m].astype("<u4").tobytes() for i, f, m, _ in placed]
        # a sequence is filled in the order of its pieces: each begins where those before it end
        order = np.argsort(s, kind="stable")
        end = np.cumsum(n[order])
        new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        offset = np.empty(len(n), np.int64)
        offset[order] = end - n[order] - (end - n[order])[new][np.cumsum(new) - 1]
        took = pa.array(p)
        columns = [group[key].take(took), starts[p] + first, n, [zlib.crc32(x) for x in raw], group["doc_tokens"].take(took), number + s, offset, pa.array(raw, pa.binary())]
        return pa.table([pa.chunked_array([pa.array(c, pa.int64())]) if isinstance(c, (list, np.ndarray)) else c for c in columns], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    cut = pieces(docs, path, key, text, sequence).withColumn("group", F.pmod(F.xxhash64("place", "start"), F.lit(groups))).drop("place")
    return cut.groupBy("group").applyInArrow(run, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed(docs: DataFrame) -> DataFrame:
    """The places of all pieces without their ids."""
    return pack(docs).drop("ids")
