"""Token ids in files coded with one canonical, length-limited Huffman code.

Texts are encoded once and their ids written; counts over all ids give the code (package-merge, at most
LIMIT bits), so there is one for the whole corpus. Ids are range-partitioned by document id, sorted and written to
files; a file is decoded from its header alone.

Layout of a file (``.vlh``, little endian): the mark ``VLH1``; six numbers of 8 bytes: size of the vocabulary,
ids a block, ids, documents, bytes of the packed code lengths, bytes of coded ids; the code lengths, a byte for each id of
the vocabulary, packed by zlib; per document its id, a byte that is 0 where that is null, and its number of ids;
per block the bit at which it begins; the coded ids; a CRC-32 of all before. Blocks are decoded independently of
each other, here many side by side, each step looking the next LIMIT bits of every block up in one table.

Files are written by Spark tasks into the shared folder under names of their own; the list of files that
the successful tasks return is the manifest, so files of lost attempts are never read.

Defined results: null and empty texts are the end id alone; null document ids come first; rows that repeat an id
come one after the other, each with its place; texts of any length are coded whole, a file holding at least
one document; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import chunks, forget, kept_in_worker, materialize, released, shared_dir
from .packing import vocabulary

VOCABULARY, END = "byte_bpe_50k.json", 0
MARK, HEAD = b"VLH1", struct.Struct("<6Q")
#: Bits of the longest code; ids between two checkpoints; ids coded at once; ids of a file, about.
LIMIT, BLOCK, SLICE, FILE_IDS = 20, 256, 1 << 20, 8 << 20
#: Bytes of text encoded at once; bytes, about, of units and ids that a Python worker keeps.
CHUNK_BYTES, CACHE_BYTES = 8 << 20, 320 << 20
_PER_UNIT = 160
#: White space of the vocabulary's word rule.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Parts of a text that its word rule never joins: a word with one space before it, and white space up to the last before a word.
_UNIT = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
#: The word rule itself, written out for characters below U+0180, of which these are white space, as Arrow's expressions are.
_FEW = [chr(i) for i in range(0x180)]
_LETTER, _NUMBER = ("".join(re.escape(c) for c in _FEW if unicodedata.category(c)[0] == k) for k in "LN")
_BLANK = r"\t-\r \x{85}\x{a0}"
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+"
#: Units with other characters, or with the byte that parts pieces here, go through the tokenizer on their own.
_OTHER = r"[^\x{1}-\x{17f}]"
#: Texts in which white space is more than single spaces, and single or double ends of lines, between words.
_ODD = r"[\t\x0b-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]| [ \n]|\n |\n\n\n|\A[ \n]|[ \n]\z"


def _by_text(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of ``x`` between edges."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[edge])


def _strings(texts: pa.Array) -> list[str]:
    """The texts as a list; ``to_pylist`` makes an Arrow scalar of each on the way."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """Ids as the tokenizer gives them, computed once per distinct unit and worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = "|".join(map(re.escape, marks)) or "[^\\x00-\U0010ffff]"
        self.marks, self.other, self.odd = re.compile(self.mark), f"{_OTHER}|{self.mark}", f"{_ODD}|{self.mark}"
        # the file's model without a cache of its own, for pieces whose bytes are already written as its characters
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.bare = Tokenizer(models.BPE(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], cache_capacity=0))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = "".join(chr(b if b in shown else 256 + hidden.index(b)) for b in range(256))
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.letters[0])
        self.bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        self.bytes[list(model["vocab"].values())] = [len(t) for t in model["vocab"]]
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, self.dtype)
        self.used = self.held = 0

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of units that were not known, now kept."""
        n = len(self.known)
        at = np.arange(n, n + len(names))
        while n + len(names) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at], self.lengths[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.held += _PER_UNIT * len(names) + sum(map(len, names)) + len(ids) * self.dtype.itemsize
        self.known.update(zip(names, at.tolist(), strict=True))
        return at

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known units one after the other, and how many each has."""
        n = self.lengths[at]
        before = np.cumsum(n)
        place = np.repeat(self.starts[at] - before + n, n)
        place += np.arange(len(place))
        return self.ids[place], n

    def _places(self, names: pa.Array, learn: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
        """The numbers of distinct units, of which new ones are learned."""
        at = np.fromiter(map(self.known.get, _strings(names), repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = learn(names.take(pa.array(new)))
        return at

    def _merge(self, pieces: pa.Array) -> np.ndarray:
        """Pieces of known characters go through the bare model, many at once; each has the ids that make up its bytes."""
        names, got = _strings(pieces), []
        for lo in range(0, len(names), 1024):
            line = codecs.charmap_decode("\0".join(names[lo : lo + 1024]).encode(), "strict", self.letters)[0]
            got.append(np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype))
        ids = np.concatenate(got)
        end, want = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64))
        last = np.minimum(np.searchsorted(end, want), len(end) - 1)
        assert end[-1] == want[-1] and (end[last] == want).all(), "a piece did not end where its ids do"
        return self._keep(names, ids, np.diff(last, prepend=-1))

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Units of known characters are cut into pieces, which recur more often; others go through the tokenizer whole."""
        other = pc.match_substring_regex(new, self.other).to_numpy(zero_copy_only=False)
        units = new.filter(pa.array(~other))
        cut = pc.split_pattern(pc.replace_substring_regex(units, _PIECE, "\\0\0"), "\0")
        flat = cut.flatten()
        coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        piece = self._places(coded.dictionary, self._merge)[coded.indices.to_numpy()]
        edge = cut.offsets.to_numpy().astype(np.int64) - np.arange(len(cut) + 1)  # a cut unit ends in an empty piece
        several = np.diff(edge) != 1
        ids, n = self._ids(piece[np.repeat(several, np.diff(edge))])
        plain = np.empty(len(units), np.int64)
        plain[~several] = piece[edge[:-1][~several]]
        plain[several] = self._keep(_strings(units.filter(pa.array(several))), ids, _by_text(n, np.cumsum(np.concatenate([[0], np.diff(edge)[several]]))))
        out = np.empty(len(new), np.int64)
        out[~other] = plain
        if other.any():
            whole = _strings(new.filter(pa.array(other)))
            got = [x.ids for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            out[other] = self._keep(whole, np.fromiter(chain.from_iterable(got), self.dtype), np.fromiter(map(len, got), np.int64))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by END; the number of each text's, with that."""
        if self.held > CACHE_BYTES:
            self.reset()
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        # plain texts are cut at spaces; a word has the space before it, but for a text's first one and those at ends of lines
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n "), " ")
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        line = pc.or_(pc.equal(words, "\n"), pc.equal(words, "")).to_numpy(zero_copy_only=False)[code]
        edge = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        bare = line | np.concatenate([[True], line[:-1]])[: len(line)]
        bare[edge[:-1][np.diff(edge) > 0]] = True
        code = code * 2 + bare
        used = np.flatnonzero(np.bincount(code, minlength=1))
        place, some = np.zeros(2 * len(words) + 1, np.int64), words.take(pa.array(used >> 1))
        place[used] = self._places(pc.if_else(pa.array(used % 2 == 1), some, pc.binary_join_element_wise(" ", some, "")), self._learn)
        ids, n = self._ids(place[code])
        count = np.zeros(len(texts), np.int64)
        count[~odd] = _by_text(n, edge)
        if odd.any():
            # in others the word rule cuts the units; a text that holds an added token's mark is one
            units = [[t] if self.marks.search(t) else _UNIT.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            coded = pa.array(list(chain.from_iterable(units)), pa.string()).dictionary_encode()
            other, n = self._ids(self._places(coded.dictionary, self._learn)[coded.indices.to_numpy()])
            count[odd] = _by_text(n, np.concatenate([[0], np.cumsum([len(x) for x in units])]).astype(np.int64))
            given = np.repeat(odd, count)
            both = np.empty(len(given), self.dtype)
            both[~given], both[given] = ids, other
            ids = both
        inner = np.ones(int(count.sum()) + len(texts), bool)
        inner[np.cumsum(count + 1) - 1] = False
        out = np.full(len(inner), END, self.dtype)
        out[inner] = ids
        return out, count + 1


TOKENS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])


def tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, crc, ids): the ids of each text with END, as little-endian binary of the vocabulary's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = path or vocabulary(VOCABULARY)
        enc = kept_in_worker(f"units {p}", lambda: UnitEncoder(p))
        for b in released(batches):
            texts = pc.fill_null(b.column("text"), "")
            for lo, hi in chunks(texts, CHUNK_BYTES):
                ids, n = enc.encode(texts.slice(lo, hi - lo))
                edge = np.concatenate([[0], np.cumsum(n)]) * enc.dtype.itemsize
                raw = ids.tobytes()
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), pa.array(n), pa.array(crc, pa.int64()), data], schema=TOKENS)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, from_arrow_schema(TOKENS))


def counts(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in ``coded``: each task sends at most one row per id, the driver holds ``size`` numbers."""
    width = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(np.concatenate([np.frombuffer(x.as_buffer(), width) for x in b.column("ids")]), minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": used, "n": n[used]})

    out = np.zeros(size, np.int64)
    for r in coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def code_lengths(n: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id's code, 0 for ids that do not occur; optimal among codes of at most ``limit`` bits."""
    used = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    if len(used) < 2:
        out[used] = 1
        return out
    leaves = used[np.argsort(n[used], kind="stable")]
    weight = n[leaves].astype(np.float64)  # sums of packages may pass 2^63
    level, single = weight, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        single.append(order < len(leaves))
    need = 2 * len(leaves) - 2
    for alone in reversed(single):
        k = int(alone[:need].sum())
        out[leaves[:k]] += 1
        need = 2 * (need - k)
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, equal ones in the order of their ids."""

    def __init__(self, bits: np.ndarray, limit: int = LIMIT):
        self.bits = bits
        order = np.flatnonzero(bits)
        order = order[np.argsort(bits[order], kind="stable")]
        room = np.int64(1) << (limit - bits[order].astype(np.int64))
        first = np.cumsum(room) - room
        self.code = np.zeros(len(bits), np.uint64)
        self.code[order] = (first >> (limit - bits[order].astype(np.int64))).astype(np.uint64)
        self.limit = limit
        self.symbol = np.zeros(1 << limit, np.uint16 if len(bits) <= 1 << 16 else np.uint32)
        self.symbol[: int(room.sum())] = np.repeat(order, room)

    def pack(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """The ids' bits, filled up to a whole byte, and the bit at which each block begins."""
        n = self.bits[ids].astype(np.int64)
        if len(n) and not n.all():
            raise ValueError("an id without a code")
        end = np.cumsum(n)
        at = end - n
        total = -(-int(end[-1]) // 8) if len(n) else 0
        # a code lies in one word of 32 bits or runs over into the next; codes of one word are added up in one go
        place = at >> 5
        word = self.code[ids] << (64 - n - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out = np.zeros(-(-total // 4) + 1, np.uint64)
        if len(n):
            out[place[first]] += np.add.reduceat(word >> np.uint64(32), first)
            out[place[first] + 1] += np.add.reduceat(word & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[:total], at[::block]

    def unpack(self, data: bytes, begins: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """``n`` ids of the blocks that begin at these bits of ``data``; all blocks are read side by side."""
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        at = begins.astype(np.int64)
        out = np.empty((min(block, n), len(at)), self.symbol.dtype)
        for i in range(len(out)):
            place = np.minimum(at >> 3, len(window) - 1)  # the last block may be shorter and read on
            out[i] = self.symbol[window[place] << (at & 7).astype(np.uint32) >> np.uint32(32 - self.limit)]
            at += self.bits[out[i]]
        return out.T.reshape(-1)[:n]


def to_file(code: Code, keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of documents with these ids, one after the other."""
    bits = zlib.compress(code.bits.tobytes(), 9)
    parts, begins, at = [], [], 0
    for lo in range(0, len(ids), SLICE // block * block):
        data, first = code.pack(ids[lo : lo + SLICE // block * block], block)
        parts.append(data)
        begins.append(first + 8 * at)
        at += len(data)
    known = np.array([k is not None for k in keys], np.uint8)
    head = HEAD.pack(len(code.bits), block, len(ids), len(keys), len(bits), at)
    places = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    body = b"".join([MARK, head, bits, np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes(), sizes.astype("<u8").tobytes(), places.astype("<u8").tobytes(), *parts])
    return body + struct.pack("<I", zlib.crc32(body))


def from_file(raw: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """The documents' ids and sizes of a file, and all token ids, some blocks at a time."""
    if raw[:4] != MARK or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("not a whole file of coded ids")
    size, block, n, docs, packed, coded = HEAD.unpack_from(raw, 4)
    at = 4 + HEAD.size
    code = Code(np.frombuffer(zlib.decompress(raw[at : at + packed]), np.uint8))
    assert len(code.bits) == size
    at += packed
    keys, known, sizes, begins = (np.frombuffer(raw, kind, k, o) for kind, k, o in (("<i8", docs, at), ("u1", docs, at + 8 * docs), ("<u8", docs, at + 9 * docs), ("<u8", -(-n // block), at + 17 * docs)))
    at += 17 * docs + 8 * len(begins)
    begins = begins.astype(np.int64)

    def ids() -> Iterator[np.ndarray]:
        step = SLICE // block
        for lo in range(0, len(begins), step):
            first = int(begins[lo]) >> 3
            end = -(-int(begins[lo + step]) // 8) if lo + step < len(begins) else coded
            yield code.unpack(raw[at + first : at + end], begins[lo : lo + step] - 8 * first, min(step * block, n - lo * block), block)

    return [int(k) if v else None for k, v in zip(keys, known, strict=True)], sizes.astype(np.int64), ids()


MANIFEST = "part long, seq long, path string, docs long, ids long, bytes long"


def write(coded: DataFrame, uri: str, size: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes ``coded`` (as ``tokens`` gives it) to files under ``uri`` in ascending order of keys, nulls first; returns the manifest."""
    sent = coded.sparkSession.sparkContext.broadcast(code_lengths(counts(coded, size)))
    total = coded.agg(F.sum("n")).first()[0] or 0
    width = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base)
        code, part = Code(sent.value), TaskContext.get().partitionId()
        seq, keys, sizes, ids, held = 0, [], [], [], 0

        def done() -> pa.RecordBatch:
            raw = to_file(code, keys, np.array(sizes, np.int64), np.concatenate(ids))
            path = f"{base}/{uuid.uuid4().hex}.vlh"
            with store.open_output_stream(path) as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "docs": [len(keys)], "ids": [held], "bytes": [len(raw)]})

        for b in released(batches):
            for k, n, x in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                keys.append(k)
                sizes.append(n)
                ids.append(np.frombuffer(x.as_py(), width))
                held += n
                if held >= file_ids:
                    yield done()
                    seq, keys, sizes, ids, held = seq + 1, [], [], [], 0
        if keys:
            yield done()

    ranged = coded.repartitionByRange(max(1, -(-int(total) // file_ids)), "key", "crc").sortWithinPartitions("key", "crc", "n")
    return materialize(ranged.mapInArrow(run, MANIFEST), "manifest")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the manifest's files; ``ids`` are unsigned 32-bit numbers, ``start`` counts those before it.

    A file is one task's; the window over the manifest has one row per file.
    """
    before = F.coalesce(F.sum("ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri)
        for b in released(batches):
            for path, base in zip(b.column("path").to_pylist(), b.column("before").to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    keys, sizes, parts = from_file(f.read())
                edge = np.concatenate([[0], np.cumsum(sizes)])
                rest, at, i = np.zeros(0, "<u4"), 0, 0
                for ids in parts:
                    rest = np.concatenate([rest, ids.astype("<u4")])
                    j = int(np.searchsorted(edge, at + len(rest), "right")) - 1
                    raw = [rest[s - at : e - at].tobytes() for s, e in zip(edge[i:j], edge[i + 1 : j + 1], strict=True)]
                    if raw:
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(base + edge[i:j]), pa.array(sizes[i:j]), pa.array(raw, pa.binary())], schema=READ)
                    rest, at, i = rest[edge[j] - at :], int(edge[j]), j

    files = materialize(manifest.select("path", before.alias("before")), "files")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, from_arrow_schema(READ))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents, reads the files, and gives one row per document read."""
    size = UnitEncoder(path or vocabulary(VOCABULARY)).size
    coded = materialize(tokens(docs, path), "tokens")
    uri = f"{shared_dir(docs.sparkSession)}/viewloom-{uuid.uuid4().hex}/ids"
    manifest = write(coded, uri, size)
    forget(coded)
    return read(manifest, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
