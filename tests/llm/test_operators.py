"""Each operator against a brute-force version or an exact round trip, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing extra columns."""

import base64
import collections
import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import fixtures as fx  # noqa: E402

from viewloom.llm import components, decontaminate, jaccard, licenses, lines, packing, quality, secrets, sharding, substrings, warc  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_packing_places_each_id_once(docs, by_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in by_id.items()}
    got = packing.packed(docs).collect()
    seen, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.update((r["doc_id"], r["start"] + i) for i in range(r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(seen) == {(d, i) for d, x in ids.items() for i in range(len(x))}
    assert {n for (d, _), n in seen.items()} == {1, 2} and all(n == (2 if d == 9 else 1) for (d, _), n in seen.items())
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert ends[-1] <= 4096 and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
    assert len(sequences) == -(-sum(map(len, [*ids.values(), ids[9]])) // 4096)


def test_equal_rows_are_spread_over_all_groups(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    got = packing.pack(docs, group_bytes=100_000).groupBy(F.shiftright("sequence_id", 32).alias("group")).agg(F.sum(F.when(F.col("start") == 0, 1)).alias("n")).collect()
    assert len(got) == 17 and sum(r["n"] for r in got) == 20_000 and max(r["n"] for r in got) < 1500


def test_packing_balances_cost():
    n = np.random.default_rng(1).integers(1, 4097, 500)
    placed = packing.balance(n)
    got = collections.Counter()
    for p, _, k, _ in placed:
        got[p] += k
    assert all(got[i] == x for i, x in enumerate(n))
    assert packing.balance(np.array([4096, 1])) and len(packing.balance(np.array([], int))) == 0


def test_encoder_equals_tokenizer_on_odd_texts():
    import pyarrow as pa

    e = packing.encoder(packing.vocabulary())
    odd = ["", "It's a\x1ctest İ Σας", "x <|endoftext|> y", "don't we'LL 12x3 ½ª\x85b\xa0c ''s", "ÀÉÞß Ĳ ŉ ſ ǅ", "a\x00b\x7f \x80", "日本 é́", "A\xadB\xa1\xff"]
    ids, n = e.encode(pa.array(odd), 2)
    want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == want


ITEMS = [(1, "w1 " * 5), (2, " ".join(f"Q{i}" for i in range(15))), (3, ""), (4, None), (5, "q3, q4"), (5, "q9"), (None, "zz yy")]


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination_equals_brute_force(spark, block):
    text = "Start " + ", ".join(f"q{i}" for i in range(14)) + " END q3-q4 zz yy"
    docs = fx.documents(spark, [text, text.upper() + fx.prose(__import__("random").Random(1), 900)])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    found = decontaminate.match(docs, bench, block_bytes=block)
    assert found.select("row.*").columns == docs.columns
    for r in found.select("row.text", "found.*").collect():
        n, hit, which, _, _ = fx.hits(r["text"], items)
        assert (r["n_words"], len(r["hits"]), len(r["items"])) == (n, hit, which)
        for s, e in zip(r["starts"], r["ends"], strict=True):
            assert fx.hits(r["text"][s:e], items)[1] > 0
    got = fx.as_dict(decontaminate.report(docs, bench))
    for d, t in {r["doc_id"]: r["text"] for r in docs.collect()}.items():
        assert tuple(got[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == fx.hits(t, items)
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not fx.hits(r["text"], items)[4] for r in docs.collect())


def test_automaton_of_a_block_fits_a_worker():
    """Its memory for each byte of benchmark, which a block of BLOCK_BYTES must keep under 1 GB."""
    import subprocess

    code = """
import random, resource
from viewloom.llm import decontaminate
rng = random.Random(1)
items = [(str(i), " ".join(f"w{rng.randrange(60000)}" for _ in range(170))) for i in range(400)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
matcher = decontaminate.Matcher(items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / sum(len(t) for _, t in items))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300, check=True)
    assert float(out.stdout.split()[-1]) * decontaminate.BLOCK_BYTES < 400 << 20


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nx", "<p>é</p>", 1), (2, None, None, 1), (3, "u", "", 1), (9, "u", "<p>é</p>", 1), (5, "u", "x" * 3_000_000, 1), (None, "n", "<p>é</p>", 1)]
    pages += [(100 + i, f"http://h/{i}", f"<html>{'word ' * 30}{i}</html>", 1) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha int")
    uri = warc.archive_uri(spark)
    manifest = warc.write(df, uri)
    back = {r["page_id"]: r for r in warc.read(manifest, uri, 3).collect()}
    group = collections.defaultdict(list)
    for p, _, h, _ in pages:
        group[h or ""].append(p or -1)
    for p, _, h, _ in pages:
        raw, top = (h or "").encode(), max(group[h or ""])
        r = back[p]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if p == top else ("revisit", top))
        assert bytes(r["payload"]) == (raw if p == top else b"")
    sizes = manifest.agg({"records": "sum", "bytes": "sum", "raw_bytes": "sum"}).first()
    assert sizes["sum(records)"] == len(pages) and sizes["sum(bytes)"] < sizes["sum(raw_bytes)"]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = fx.documents(spark)
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    clean = decontaminate.report(docs, bench.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r["n_hit"] or r["n_items"] or r["contaminated"] for r in clean)


BIG = 1 << 60


def test_large_ids_beside_nulls_stay_exact(spark):
    rows = [(BIG + 1, "a b c d e f token=abcdefgh"), (BIG + 3, "a b c d e f token=abcdefgh"), (None, "x"), (BIG + 5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(BIG + 7, "c d"), (None, "q")], "item_id long, text string")
    ids = sorted(d for d, _ in rows if d)
    for f in (packing.packed, lambda d: decontaminate.report(d, bench), substrings.report, lines.report, sharding.shards, secrets.report, jaccard.report, quality.verdicts):
        assert sorted(r["doc_id"] for r in f(docs).collect() if r["doc_id"]) == ids
    assert {r["component_id"] for r in jaccard.report(docs).collect()} == {BIG + 1, BIG + 5, None}
    files = docs.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string")))
    assert sorted(r["doc_id"] for r in licenses.inherit(licenses.own_license(files)).collect() if r["doc_id"]) == ids
    pages = spark.createDataFrame([(BIG + 1, "u", "same"), (BIG + 3, "u", "same"), (None, "u", "same"), (7, "u", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {BIG + 1: ("revisit", BIG + 3), BIG + 3: ("response", None), None: ("revisit", BIG + 3), 7: ("response", None)}


def test_warc_of_nothing_and_damage(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError, match="WARC"):
        warc.parse(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError, match="end"):
        warc.parse(warc.record(1, "u", b"abc", warc.sha1(b"abc"), None)[:-3])


def _template(name, i=0):
    return licenses.TEMPLATES[name][i]


def test_license_scan(spark):
    wrapped = "import x\n# Licensed under the Apache\n# License, Version 2.0.\nprint(1)"
    header = "/*\n * Copyright 2020 Someone\n *\n * " + _template("Apache-2.0", 2).replace(" may", "\n * may").replace(" You", "\n * You") + "\n *\n *     http://x.org/\n */\nint main() {}\n"
    body = "MIT License\n\nCopyright (c) 2021 A. Person\n\n" + "\n\n".join(_template("MIT", 2).replace("files (the", "files (the\n").split(": ")) + "\n"
    files = [
        (1, "a/LICENSE", _template("MIT")), (2, "a/b/c/code.py", "print"), (3, "a/b/x.py", "/* " + _template("Apache-2.0") + " */"),
        (4, "z/y.py", None), (5, "LICENSE.md", _template("GPL-3.0")), (6, None, ""), (7, "a/b/LICENSE", "nothing here"), (8, "z/y.py", "long " * 5000 + "\n" + _template("CC-BY-NC-4.0")),
        (9, "w/x.py", wrapped), (10, "w/y.c", header), (11, "m/LICENSE-MIT.txt", body), (12, "m/sub/q.py", "pass"), (13, "g/COPYING", _template("GPL-2.0") + "\n\n" + "Preamble of the text. " * 900),
        (14, "r/x.py", "Released under the\n\n\nMIT\n\nLicense."), (15, "e/LICENSE", "\n" * 50_000 + _template("Zlib") + "\n" * 50_000), (16, "t/x.py", _template("AGPL-3.0", 1)), (17, "t/y.py", _template("GPL-3.0", 2)), (18, "t/z.py", "software license permission notice " * 40),
    ]
    df = spark.createDataFrame([(*f, 1, 2, 3) for f in files], "doc_id long, path string, text string, row int, dir int, best int")
    out = licenses.inherit(licenses.own_license(df))
    assert out.columns == [*df.columns, "own_license", "own_score", "license", "license_from"]
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_from"]) for r in out.collect()}
    assert got[2] == (None, "MIT", "a") and got[3][0] == "Apache-2.0" and got[4] == (None, "GPL-3.0", "")
    assert got[6] == (None, None, None) and got[7] == (None, "MIT", "a") and got[8] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "own")
    assert [got[d][0] for d in (9, 10, 11, 13, 14, 15, 16, 17, 18)] == ["Apache-2.0", "Apache-2.0", "MIT", "GPL-2.0", "MIT", "Zlib", "AGPL-3.0", "GPL-3.0", None]
    assert got[12] == (None, "MIT", "m")
    assert licenses.inherit(licenses.own_license(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found_in_a_comment(name):
    """Each template, wrapped at 70 characters and marked as a comment, is one paragraph whose best template is its own license's."""
    import textwrap

    kinds = licenses.vocabulary(licenses.TEMPLATES)
    for text in licenses.TEMPLATES[name]:
        said = collections.Counter(t for t in re.split("[^0-9a-z]+", "\n".join(f"# {x}" for x in textwrap.wrap(text, 70)).lower()) if t)
        dot = lambda a, b: sum(n * b[v] for v, n in a.items())
        cos = [(dot(said, tf) / (dot(said, said) * dot(tf, tf)) ** 0.5, n) for n, tf in kinds]
        assert max(cos)[0] > 0.999 and name in {n for c, n in cos if c == max(cos)[0]}


def test_license_ties_and_repeated_rows(spark):
    rows = [(1, "d/LICENSE", _template("MIT")), (2, "d/COPYING", _template("Apache-2.0")), (3, "d/x", ""), (3, "d/x", ""), (None, "d/y", None), (None, None, _template("MIT"))]
    out = licenses.inherit(licenses.own_license(spark.createDataFrame(rows, "doc_id long, path string, text string"))).collect()
    assert len(out) == len(rows) and {r["license"] for r in out if r["path"] and r["path"][2] in "xy"} == {"MIT"}
    assert [r["license"] for r in out if r["path"] is None] == ["MIT"]


def _runs_by_hand(sizes):
    """Every run of two sentences, or where these have too few words the shortest longer ones from its start and to its end."""
    m, enough = len(sizes), lambda i, j: sum(sizes[i:j]) >= substrings.LEAST
    found = set()
    for k in range(m - 1):
        if enough(k, k + 2):
            found.add((k, k + 2))
        else:
            found |= {(k, e) for e in range(k + 3, m + 1) if enough(k, e) and not enough(k, e - 1)}
            found |= {(b, k + 2) for b in range(k) if enough(b, k + 2) and not enough(b + 1, k + 2)}
    return found or ({(0, m)} if m > 1 else set())


def _deduped_by_hand(texts):
    """Each text without the sentences of every run that an earlier place in (document, place) order has."""
    at, out = collections.defaultdict(list), {}
    cut = {d: [(i, s.lower().split()) for i, s in enumerate(substrings.sentences(t or "")) if s.strip()] for d, t in texts.items()}
    for d, said in cut.items():
        for i, j in _runs_by_hand([len(w) for _, w in said]):
            at[tuple(tuple(w) for _, w in said[i:j])].append((d, i, j))
    lost = collections.defaultdict(set)
    for places in at.values():
        for d, i, j in sorted(places)[1:]:
            lost[d] |= {cut[d][k][0] for k in range(i, j)}
    for d, t in texts.items():
        out[d] = None if t is None else "".join(s for i, s in enumerate(substrings.sentences(t)) if i not in lost[d])
    return out


def test_substring_dedup_equals_brute_force(docs, by_id):
    want = _deduped_by_hand(by_id)
    out = substrings.dedup(docs)
    assert [c for c in docs.columns if c in out.columns] == docs.columns
    for r in out.collect():
        t = by_id[r["doc_id"]]
        assert "".join(substrings.sentences(t or "")) == (t or "")
        assert r["text"] == want[r["doc_id"]] and r["n_removed"] == len(t or "") - len(want[r["doc_id"]] or "")
        assert r["n_removed"] == sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True))
    assert sum(want[d] != t for d, t in by_id.items()) >= 6


def test_repeats_within_a_document_and_short_copies_go(spark):
    rng = __import__("random").Random(6)
    line = "One short line of text."
    passage = " ".join(fx.prose(rng, 9) + "." for _ in range(7))
    texts = ["\n".join([line] * 30), f"{fx.prose(rng, 20)}. {passage} {fx.prose(rng, 20)}. {passage} {fx.prose(rng, 20)}.", "Two words. And three more.", "Two words. And three more.", "alone", "alone"]
    texts += [" ".join(f"{rng.choice('abc')} {rng.choice('xyz')}." for _ in range(rng.randrange(2, 40))) for _ in range(40)]
    texts = dict(enumerate(texts))
    got = {d: r["text"] for d, r in fx.as_dict(substrings.dedup(_passage_rows(spark, list(texts.values())))).items()}
    assert got == _deduped_by_hand(texts)
    assert got[0].split("\n").count(line) == 1 and got[1].count(passage) == 1 and (got[2], got[3], got[5]) == (texts[2], "", "alone")


def test_passages_go_from_all_but_the_first(docs, by_id):
    out = fx.as_dict(substrings.dedup(docs))
    first, *rest = [d for d, t in by_id.items() if (t or "").startswith("Intro number")]
    assert out[first]["text"] == by_id[first]
    assert all(out[d]["text"].startswith("Intro number") and "Outro" in out[d]["text"] and len(out[d]["text"]) < 60 for d in rest)


def _passage_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("sizes", [[6] * 10, [1] * 60, [3, 9, 2, 10, 10, 2, 4, 12, 1, 5], [10, 10, 2, 10, 10, 10, 2]])
def test_passages_of_short_sentences_are_found_whole(spark, sizes):
    rng = __import__("random").Random(3)
    passage = "".join(fx.prose(rng, n) + ".\n" for n in sizes)
    texts = [f"{fx.prose(rng, 9)}.\n{passage}{fx.prose(rng, 9)}." for _ in range(3)]
    out = fx.as_dict(substrings.dedup(_passage_rows(spark, texts)))
    assert out[0]["text"] == texts[0]
    assert all(out[i]["text"] == texts[i].replace(passage, "") for i in (1, 2))


def test_passages_that_begin_mid_sentence(spark):
    rng = __import__("random").Random(4)
    texts, want = [], 0
    for i in range(40):
        passage = fx.prose(rng, 120)
        texts += [f"{fx.prose(rng, 20 + k * (i % 24 + 1))} {passage} {fx.prose(rng, 20)}." for k in (0, 1)]
        want += len(passage)
    out = fx.as_dict(substrings.dedup(_passage_rows(spark, texts)))
    assert sum(out[i]["n_removed"] for i in range(0, 80, 2)) == 0
    assert all(out[i]["n_removed"] > 0 for i in range(1, 80, 2)) and sum(out[i]["n_removed"] for i in range(1, 80, 2)) > 0.6 * want


def test_pieces_join_to_the_sentence_and_keep_their_sizes():
    for t in (fx.prose(__import__("random").Random(5), 5000), "a b c d e " * 60, "x " * 400, "a\tb\tc " * 30):
        cut = substrings.sentences(t)
        assert "".join(cut) == t and all(substrings.LEAST // 2 <= len(s.split()) <= substrings.LONG for s in cut)


def test_line_dedup_equals_brute_force(docs, by_id):
    want = fx.deduped_lines(by_id)
    out = lines.dedup(docs)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    for r in out.collect():
        assert (r["text"], r["n_removed"]) == want[r["doc_id"]]


def test_sharding_moves_only_to_the_new_shard(docs, by_id):
    got = sharding.shards(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shards_equal_an_independent_descent(docs):
    """Regions 0 and 1 hold the shards of that parity, racks alternate within; a ninth shard is a region of its own."""
    import math

    import xxhash

    def draw(key, name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return -math.log(((h >> 12) + 1.0) / 2.0**52) / weight

    def descend(key, grown):
        regions = {"r0": {"r0/k0": [0, 4], "r0/k1": [2, 6]}, "r1": {"r1/k0": [1, 5], "r1/k1": [3, 7]}} | ({"x8": {"x8/k": [8]}} if grown else {})
        region = min(regions, key=lambda r: draw(key, r, sum(map(len, regions[r].values()))))
        racks = regions[region]
        rack = min(racks, key=lambda k: draw(key, k, len(racks[k]))) if len(racks) > 1 else next(iter(racks))
        return min(racks[rack], key=lambda s: draw(key, f"s{s}", 1)) if len(racks[rack]) > 1 else racks[rack][0]

    for r in sharding.shards(docs).collect():
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (descend(key, False), descend(key, True))


def test_weights_move_keys_within_their_subtree_only(spark):
    def layout(w):
        leaf = lambda n, x: sharding.Node(f"s{n}", x, n)
        return sharding.Node("root", children=(sharding.Node("r0", children=(leaf(0, w), leaf(1, 2 - w))), sharding.Node("r1", children=(leaf(2, 1.0), leaf(3, 1.0)))))

    df = spark.range(4000)
    moved = sharding.assign(sharding.assign(df, "id", layout(1.0)), "id", layout(1.5), "later").groupBy("shard", "later").count().collect()
    changes = {(r["shard"], r["later"]): r["count"] for r in moved}
    assert all(a == b or (a, b) == (1, 0) for a, b in changes) and 350 < changes[1, 0] < 650
    share = sharding.assign(df, "id", layout(1.5)).where("shard = 0").count() / 4000
    assert abs(share - 0.375) < 0.03


def test_secret_scan_equals_rule(docs, by_id):
    assign = """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = [("assign", re.compile(assign, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for r in secrets.report(docs).collect():
        spans, n = [], []
        for i, (k, rule, group, least) in enumerate(rules):
            own = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for m in rule.finditer(by_id[r["doc_id"]] or "") if len(m[group]) >= least]
            spans += own
            n.append(len(own))
        text = ",".join(x[2] for x in sorted(spans))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == n and r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert secrets.report(docs).count() == docs.count()


def test_ledger_scans_each_blob_once(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x")], "doc_id long, text string")
    found, _ = secrets.scan_unseen(df)
    entries = secrets.ledger_entries(found).cache()
    assert found.count() == 2 and entries.count() == 2
    more = df.union(spark.createDataFrame([(4, "secret: zzzzzzzz"), (5, "x")], "doc_id long, text string"))
    assert secrets.scan_unseen(more, entries)[0].count() == 1


def test_second_run_keeps_the_findings_of_old_paths(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = [(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x"), (4, None)]
    more = [*rows, (5, "secret: zzzzzzzz"), (6, "x"), (7, "token=abcdefgh")]
    first, second = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows, more))
    assert sum(r["n_assign"] for r in secrets.report(first, path).collect()) == 2
    assert secrets.read_ledger(spark, path).count() == 3
    ledger = secrets.read_ledger(spark, path)
    want = fx.as_dict(secrets.report(second))
    assert sum(r["n_assign"] for r in want.values()) == 4
    assert {r["doc_id"] for r in secrets.findings(second, ledger).collect() if r["kinds"]} == {1, 2, 5, 7}
    assert fx.as_dict(secrets.report(second, path)) == want
    assert secrets.read_ledger(spark, path).count() == 4
    stale = spark.createDataFrame([(r["blob"], "older", ["hex"], [0], [1]) for r in want.values()], secrets.FOUND)
    stale.write.mode("append").parquet(path)
    assert fx.as_dict(secrets.report(second, path)) == want


def test_jaccard_components_equal_brute_force(docs, by_id):
    want = fx.components(by_id)
    got = jaccard.report(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_jaccard_of_families_that_straddle_the_limit(spark):
    """Many variants of few texts, of all sizes, so that links, chains and near misses all occur."""
    rng = __import__("random").Random(9)
    rows = []
    for n in (5, 9, 14, 40, 90, 260, 700):
        base = [f"v{rng.randrange(90)}" for _ in range(n)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + n // 30 + 2)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(900)}"
            cut = rng.randrange(0, n // 5 + 1)
            rows.append(" ".join(w[cut:] if rng.random() < 0.3 else w))
    data = dict(enumerate(rows))
    got = jaccard.report(spark.createDataFrame(list(data.items()), "doc_id long, text string")).collect()
    want = fx.components(data)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_of_chains_whose_rows_occur_twice(spark):
    """Buckets of equal ids an even number of times must not count as buckets with the same members."""
    rng = __import__("random").Random(12)
    rows = []
    for n in (14, 40, 90, 260):
        for _ in range(6):
            base = [f"v{rng.randrange(4000)}" for _ in range(n)]
            for _ in range(8):
                for _ in range(max(1, n // 60)):
                    base[rng.randrange(len(base))] = f"n{rng.randrange(9000)}"
                rows.append(" ".join(base))
    data = dict(enumerate(rows))
    for times in (lambda d: 2, lambda d: 1 + d % 2):
        got = jaccard.report(spark.createDataFrame([x for x in data.items() for _ in range(times(x[0]))], "doc_id long, text string")).collect()
        assert len(got) == sum(map(times, data))
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, *x) for d, x in fx.components(data).items()}


def test_jaccard_of_buckets_larger_than_a_block(spark, monkeypatch):
    """A large family, several near ones that share most of its text, and copies: buckets are cut into many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = __import__("random").Random(21)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for family in range(5):
        own = [f"f{family}x{i}" if i % 5 == 0 and family else w for i, w in enumerate(base)]
        for _ in range(40 if family == 0 else 9):
            w = list(own)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(150)] = f"n{rng.randrange(900)}"
            rows.append(" ".join(w))
    data = dict(enumerate(rows + rows[:7]))
    got = jaccard.report(spark.createDataFrame(list(data.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == fx.components(data)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    for n in (10, 100, 1000):
        a = rng.integers(0, 1 << jaccard.BITS, n, dtype=np.uint64)
        b = np.concatenate([a[n // 10 :], rng.integers(0, 1 << jaccard.BITS, n // 8 + 1, dtype=np.uint64)])
        x, y = (np.frombuffer(jaccard.sketch(v), np.uint8) for v in (a, b))
        size = min(len(x), len(y))
        far = np.bitwise_count(jaccard._fold(x, size) ^ jaccard._fold(y, size)).sum()
        assert far <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_keep_first_leaves_one_of_each_group(docs, by_id):
    want = fx.components(by_id)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}


def test_quality_measurements_equal_brute_force(docs, by_id):
    got = quality.verdicts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = fx.quality(by_id[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_filters_on_verdicts_end_on_long_texts(spark):
    rng = __import__("random").Random(2)
    rows = [(i, fx.prose(rng, 20_000 if i % 50 == 0 else 200)) for i in range(200)]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 200 and got.where("base_failed").count() == 0 and got.where("n_repeat_words > 0").count() < 200


def test_rules_of_other_scripts(spark):
    rows = [(1, "Это обычный русский текст про ООН, НАТО, США, СНГ и ЕС " * 3 + "x y NATO USA UNESCO"), (2, "WHO NATO UNESCO UNICEF OPEC " + "هذا نص عربي عادي عن العالم والناس والمدن " * 12), (3, "今天天气很好我们去公园散步" * 9 + " 一 二 三 四 五 六 七 八 九"), (4, " ".join(f"LOUD WORDS NUMBER {i}" for i in range(20)))]
    got = {r["doc_id"]: r["fail_bits"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bit = lambda name: 1 << [r.name for r in quality.RULES].index(name)
    assert not any(got[d] & (bit("capitals") | bit("long_words")) for d in (1, 2, 3)) and got[4] & bit("capitals")


def test_ablations_count_what_a_rule_costs(docs):
    entries = quality.ledger(docs).cache()
    for r in quality.ablations(entries).collect():
        p = next(p for p in quality.POLICIES if p.version == r["policy"])
        less = quality.Policy("x", tuple(x for x in p.rules if x != r["rule"]), p.tolerated)
        assert r["kept_with"] == quality.apply_policy(entries, p).where("kept").count()
        assert r["kept_without"] == quality.apply_policy(entries, less).where("kept").count()


@pytest.mark.parametrize("f", [packing.packed, substrings.report, lines.report, sharding.shards, secrets.report, jaccard.report, quality.verdicts, lines.keep_rest, jaccard.keep_first, licenses.report])
def test_empty_table(spark, f):
    assert f(fx.empty(spark)).count() == 0


@pytest.mark.parametrize("f", [packing.packed, substrings.report, lines.report, sharding.shards, secrets.report, jaccard.report, quality.verdicts])
def test_null_and_repeated_ids(spark, f):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "x y z"), (1, "other text with words"), (None, None)]
    assert f(spark.createDataFrame(rows, "doc_id long, text string")).count() >= len(rows)
