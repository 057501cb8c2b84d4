"""Spelling variants, coded ids and periodic runs against brute force and exact round trips."""

import collections
import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import fixtures as fx  # noqa: E402

from viewloom.llm import huffman, periodic, spelling  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced character tells a from b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    """The contract of spelling variants over {word: n}, by comparing all pairs."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def misspelt(rng, n):
    base = ["banana", "aaaaaaaa", "straße", "ünïcödé", "letters", "abcabcabc", "lettres"] + ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(4, 12))) for _ in range(30)]
    out = []
    for _ in range(n):
        w = rng.choice(base)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abÿ") + w[i + 1 :]])
        out.append(w)
    return out


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in misspelt(rng, 80)) + rng.choice([".", " 1x2, Ωmega", ""])) for i in range(150)]
    rows += [(None, None), (None, "banana; banana"), (7, ""), rows[3], rows[3], (9000, "long" * 30_000)]
    counts = collections.Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = fx.lowered(run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = spelling.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == grouped(counts) and len(got) == len(counts) > 100


def test_roots_of_long_paths_and_ties(spark):
    chain = [("ab" * 3 + "c" * k, 3 << (30 - k)) for k in range(30)]  # each is near the next, of half its count
    rows = [*chain, ("zzzzz", 5), ("zzzzy", 10), ("zzzzx", 10), ("zzzza", 9)]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == grouped(dict(rows)) and got["zzzzz"][0] == "zzzzx" and got[chain[-1][0]][1] == "ababab"


def test_spelling_of_fixture_and_nothing(spark, docs):
    assert spelling.report(fx.empty(spark)).count() == 0
    assert spelling.report(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(spark.createDataFrame([("alone", 4)], "word string, n long")).collect() == [("alone", None, "alone", 4, 0, None)]


def tokenized(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*x.ids, 0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_units_encode_as_the_tokenizer_does():
    import public_tokenizers

    e = huffman.UnitEncoder(public_tokenizers.path(huffman.VOCABULARY))
    rng = random.Random(1)
    letters = "ab 'sé日1!  \n\n\t\r\x0b\x1c\x1d\x85\xa0​　 ﻿<|tIſ’"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    odd += [re.sub(r"\s+", lambda m: m[0][:1], x) for x in odd] + ["x <|endoftext|> y", "don't we'LL  it's 's\n's", "a\0b \0", "", "two\n\nparts\n\n\nthree"]
    for texts in (odd, odd[::-1], [], ["x"]):
        ids, n = e.encode(pa.array(texts, pa.string()))
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == (tokenized(texts) if texts else [[]])


class Asked(dict):
    """A dict that counts how often it is asked."""

    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_units_are_looked_up_once_and_pieces_go_through_the_model_alone(monkeypatch):
    import public_tokenizers

    e = huffman.UnitEncoder(public_tokenizers.path(huffman.VOCABULARY))
    words = ["".join(x) for x in itertools.product("abcdefghij", repeat=3)]
    texts = pa.array([" ".join(["a", *words, *(f"{w}, {w}! {w}-{w}" for w in words)])] * 3)
    units, pieces = 1 + len(words) * 4, 1 + len(words) * 2 + 3  # " w", " w,", " w!" and " w-w"; "a", " w", "w" and three marks
    sent, model = [], e.bare

    class Bare:
        def encode_batch_fast(self, lines, **options):
            out = model.encode_batch_fast(lines, **options)
            sent.extend(out[0].ids)
            return out

    monkeypatch.setattr(e, "bare", Bare())
    e.known = Asked()
    ids, n = e.encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == tokenized(texts.to_pylist())
    assert e.known.asked == units + pieces and len(sent) == sum(len(x) - 1 for x in tokenized(["a", *words, *(f" {w}" for w in words), ",", "!", "-"]))
    e.encode(texts)
    assert e.known.asked == 2 * units + pieces


def test_coded_ids_come_back_in_order(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    ids = tokenized([r["text"] for r in rows])
    size = huffman.UnitEncoder(huffman.vocabulary(huffman.VOCABULARY)).size
    uri = f"{huffman.shared_dir(spark)}/ids-test"
    for file_ids in (huffman.FILE_IDS, 5000):
        manifest = huffman.write(huffman.tokens(docs), uri, size, file_ids)
        got = sorted(huffman.read(manifest, uri).collect(), key=lambda r: r["start"])
        assert manifest.count() > (file_ids == 5000) and manifest.agg({"ids": "sum"}).first()[0] == sum(map(len, ids))
        assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in rows)
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
        want = dict(zip([r["doc_id"] for r in rows], ids, strict=True))
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] for r in got)


def test_coded_ids_of_nulls_repeats_and_nothing(spark):
    rows = [(5, "x y"), (None, "b"), (None, None), (5, "other"), (1 << 60, ""), (-3, "a")]
    got = sorted(huffman.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -3, 5, 5, 1 << 60]
    crc = lambda t: zlib.crc32(np.array(tokenized([t])[0], "<u4").tobytes())
    assert sorted(r["ids_crc32"] for r in got) == sorted(crc(t) for _, t in rows)
    assert huffman.round_trip(fx.empty(spark)).count() == 0


def test_codes_are_optimal_within_the_limit():
    import heapq

    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 300):
        counts = np.concatenate([rng.integers(1, 1 << rng.integers(1, 30), n), [0, 0]])
        bits = huffman.code_lengths(counts, 40)
        heap = sorted(int(c) for c in counts if c)
        total = heap[0] if n == 1 else 0
        while len(heap) > 1:
            pair = heapq.heappop(heap) + heapq.heappop(heap)
            total += pair
            heapq.heappush(heap, pair)
        assert int((counts * bits).sum()) == total and not bits[-2:].any()
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    for limit in (6, 9, 20):
        bits = huffman.code_lengths(np.array(fib), limit)
        assert bits.max() <= limit and (2.0 ** -bits.astype(float)).sum() == 1
    with pytest.raises(ValueError, match="more ids"):
        huffman.code_lengths(np.ones(10), 3)


def test_blocks_are_read_on_their_own_and_damage_is_seen():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 70_000) % 5000).astype(np.uint16)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=5001)))
    data, begins = code.pack(ids)
    assert (code.unpack(data, begins, len(ids)) == ids).all()
    k = 100
    assert (code.unpack(data, begins[k : k + 1], huffman.BLOCK) == ids[k * huffman.BLOCK : (k + 1) * huffman.BLOCK]).all()
    raw = huffman.to_file(code, [4, None], np.array([30_000, 40_000]), ids)
    keys, sizes, parts = huffman.from_file(raw)
    assert keys == [4, None] and sizes.tolist() == [30_000, 40_000] and (np.concatenate(list(parts)) == ids).all()
    with pytest.raises(ValueError, match="whole file"):
        huffman.from_file(raw[:-9] + bytes(9))
    with pytest.raises(ValueError, match="without a code"):
        code.pack(np.array([1, 5000]))


def runs_of(w):
    """Every run by trying every period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            if w[x] != w[x + q]:
                x += 1
                continue
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            if y + q - x >= max(12, 2 * q):
                found.setdefault((x, y + q), q)
            x = y
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randrange(220), rng.choice([1, 2, 2, 3, 5, 40])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 20:
                p, a = rng.randrange(1, n // 2), rng.randrange(n)
                for i in range(a, a + rng.randrange(n - a)):
                    w[i] = w[a + (i - a) % p]
        assert periodic.find_runs(np.array(w, np.int64)) == runs_of(w), w


def test_runs_of_small_automata(monkeypatch):
    monkeypatch.setattr(periodic, "AUTOMATON_WORDS", 16)
    test_runs_equal_brute_force()


def test_runs_of_very_long_texts():
    n = 400_000
    same = np.zeros(n, np.int64)
    assert periodic.find_runs(same) == [(0, n, 1)]
    assert periodic.find_runs(np.arange(n) % (n // 3)) == [(0, n, n // 3)]
    assert periodic.find_runs(np.arange(n)) == []
    assert periodic.find_runs(np.arange(n) % 12) == [(0, n, 12)]


def want_runs(d, t):
    w = fx.WORD.findall(t or "")
    n = len(w)
    h = 1 if d is None else zlib.crc32(str(d).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    lost = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(((-k, s, q) for s, k, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in lost)))


def test_periodic_report_equals_brute_force(spark, docs):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    rows += [(1000 + i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(120)))) for i in range(120)] + [(None, "a b " * 9), (None, None), (2000, "x " * 13)]
    got = collections.Counter(tuple(r) for r in periodic.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == collections.Counter((d, *want_runs(d, t)) for d, t in rows)
    changed = periodic.planted(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 5 < sum(a != b for a, b in zip(rows, map(tuple, changed.collect()), strict=True)) < 40


def test_repeats_keep_the_columns(spark, docs):
    out = periodic.repeats(docs)
    assert out.select("row.*").columns == docs.columns and out.columns == ["row", "runs", "collapsed"] and out.count() == docs.count()
    assert periodic.report(fx.empty(spark)).count() == 0
