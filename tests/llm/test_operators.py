"""The operators against plain versions, on a corpus with every odd case."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxquery.llm import anchors, components, decontam, filter_audit, importance, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, repeats, substrings, token_counts, warc
from boxquery.llm._common import written

from .conftest import LOW

SPACE_WORD = re.compile(r"[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def same(df, want, *columns):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(want, key=repr)


def documents(rows):
    """Distinct (id, text) with its key in the order of documents; rows of both equal are one document."""
    return sorted({(2**63 - 1 if i is None else i, t or "") for i, t, _ in rows})


# 1 repeats


def brute_repeats(texts, width):
    count = collections.Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out.append((len(t), sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("most, values, noted", [(repeats.INDEX_CLASSES, anchors.MOST_VALUES, 40), (1, anchors.MOST_VALUES, 60), (1, 0, 40)])
def test_repeats(docs, rows, monkeypatch, most, values, noted):
    monkeypatch.setattr(repeats, "INDEX_CLASSES", most)
    monkeypatch.setattr(anchors, "MOST_VALUES", values)
    texts = [(t or "").encode() for _, t, _ in rows]
    total = lambda c: F.aggregate(F.transform(c, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    got = repeats.remove_repeats(docs, 60, noted, 16).withColumns({"r": total("removed"), "s": total("noted")})
    long, short = brute_repeats(texts, 60), brute_repeats(texts, noted)
    same(got.withColumn("kept", F.sha2("kept", 256)), [(i, n, r, s, hashlib.sha256(k).hexdigest()) for (i, _, _), (n, r, k), (_, s, _) in zip(rows, long, short, strict=True)], "doc_id", "n_bytes", "r", "s", "kept")


def test_repeats_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_run_length_index_matching_statistics():
    rng = np.random.default_rng(1)
    for trial in range(40):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 25)).astype("u1")) for _ in range(rng.integers(1, 5))]
        if trial % 3 == 0 and len(texts) > 1:
            texts[1] = texts[0]
        tails = [t[k:] for t in texts for k in range(len(t) + 1)]
        common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        want = [max((common(a, b) for j, b in enumerate(tails) if i != j), default=0) for i, a in enumerate(tails)]
        index = repeats.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        assert index.matching_statistics().tolist() == want
        assert len(index.heads) == len(index.run_symbols)


# 2 mixing


def test_mixing(docs, rows):
    got = [r.asDict() for r in mixing.mix(docs, block_words=16).collect()]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(SPACE_WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(SPACE_WORD.findall(t or ""))) for i, t, _ in rows)
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 3)] += r["taken"]
    for s in order:
        assert abs(taken[sizes[s], round(target[s], 3)] - target[s]) <= 0.02 * target[s] + 16
    again = mixing.mix(docs.repartition(3), block_words=16).collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix(docs, block_words=16).collect())


def test_mixing_empty(empty, spark):
    assert mixing.mix(empty).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]


def test_a_source_fills_its_slots_through_a_permutation(spark):
    sources = mixing.with_blocks(spark.createDataFrame([("a", 0, 10_000, 13_000.0)], "source string, sid int, source_size long, target double"), 100)
    got = mixing.slots(sources, shard_slots=10).collect()
    assert sum(r.words for r in got) in range(12_990, 13_001)
    assert sorted(r.block for r in got if r["pass"] == 0) == list(range(100)) and len({r.shard for r in got}) > 5


def test_the_mixture_is_dealt_over_shards_and_holds_the_words(docs, rows):
    got = mixing.mixture(docs, block_words=16, shard_slots=64).collect()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        assert r.words == len(r.text.split(" "))
    assert len(shards) == -(-len(got) // 64) and len(shards) > 5
    assert all(sorted(r.position for r in s) == list(range(len(s))) for s in shards.values())
    # no shard is one source's: every large source is in every shard, near its share
    counts = collections.Counter(r.source for r in got)
    for s in shards.values():
        for source, n in counts.items():
            share = n / len(got)
            assert abs(sum(r.source == source for r in s) - share * len(s)) <= 6 * (share * len(s)) ** 0.5 + 1
    # the words: of each source as many as mix() takes, and no word more than twice
    have, mixed = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, t, s in rows:
        have[s].update(SPACE_WORD.findall(t or ""))
    for r in got:
        mixed[r.source].update(r.text.split(" "))
    assert all(n <= 2 * have[s][w] for s in mixed for w, n in mixed[s].items())
    taken = sum(r.taken for r in mixing.mix(docs, block_words=16).collect())
    assert taken == sum(r.words for r in got)
    again = mixing.mixture(docs.repartition(3), block_words=16, shard_slots=64).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_the_order_of_all_slots_is_a_permutation(spark):
    totals = (1, 2, 3, 64, 65, 1000)
    got = spark.createDataFrame([(n, k) for n in totals for k in range(n)], "n long, k long").select("n", mixing.shuffled("k", "n").alias("p")).collect()
    for n in totals:
        assert sorted(r.p for r in got if r.n == n) == list(range(n))
    # totals beyond 32 bits, and that of the longest order: no number is out of it or taken twice, and the halves of the order are dealt alike
    large = [2**32, 2**32 + 1, 2**33, 2**40, 10**15, 2**61]
    ends = [(n, k) for n in large for k in [*range(3000), *range(n // 3, n // 3 + 3000), *range(n - 3000, n)]]
    found = collections.defaultdict(set)
    for r in spark.createDataFrame(ends, "n long, k long").select("n", mixing.shuffled("k", "n").alias("p")).collect():
        assert 0 <= r.p < r.n
        found[r.n].add(r.p)
    assert {n: len(p) for n, p in found.items()} == dict.fromkeys(large, 9000)
    assert all(0.45 < sum(p < n // 2 for p in places) / 9000 < 0.55 for n, places in found.items())


# 3 WARC


def test_warc(spark):
    html = ["<p>a</p>", "<p>b</p>", None, "", "<p>a</p>", "é" * 5000, "<p>b</p>", "x\r\n\r\ny"]
    pages = spark.createDataFrame([(k, "http://h/a b\nc" if k else None, h, "z") for k, h in enumerate(html)] + [(None, "http://n", "<p>a</p>", "z"), (0, "http://0", "<p>a</p>", "z")], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write_archives(pages, file_bytes=600)
    assert index.select("file").distinct().count() > 1
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {"<p>a</p>": 0, "<p>b</p>": 1, "": 2, "é" * 5000: 5, "x\r\n\r\ny": 7}
    want = []
    for page, h in [*enumerate(html), (None, "<p>a</p>"), (0, "<p>a</p>")]:
        head = first[h or ""]
        want.append((page, len((h or "").encode()), digest(h), "response" if page == head else "revisit", None if page == head else head))
    same(warc.read_records(index), want, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    some = warc.read_records(index.where("page_id in (5, 7)"), payload=True, gap=0)
    same(some, [(5, ("é" * 5000).encode()), (7, b"x\r\n\r\ny")], "page_id", "payload")
    all_whole = warc.read_records(warc.write_archives(pages, min_revisit_bytes=6))
    assert {r.page_id for r in all_whole.where("record_type = 'response'").collect()} >= {2, 3}


def test_warc_empty(spark):
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# 4 token counts


def test_token_counts(docs, rows):
    library = token_counts._transducer("piece_bpe_32k.model").library
    want = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    same(token_counts.token_counts(docs), want, "doc_id", "n_bytes", "n_tokens")


def test_state_maps_compose_at_any_cut():
    transducer = token_counts._transducer("piece_bpe_32k.model")
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "\n\n", "▁", "é", "漢", "\t", "<s>", "12"]) for _ in range(rng.randrange(0, 25)))
        assert {transducer.count(text, k) for k in (1, 2, 3, 7, 100)} == {len(transducer.library.encode(text))}, repr(text)


def test_token_counts_empty(empty):
    assert token_counts.token_counts(empty).count() == 0


# 5 substrings


def brute_later(rows, width):
    seen, out = set(), {}
    for i, t in rows:
        words = SPACE_WORD.findall(t)
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out[i, t] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("most", [substrings.GROUP_CLASSES, 1])
def test_substrings(docs, rows, monkeypatch, most):
    monkeypatch.setattr(substrings, "GROUP_CLASSES", most)
    got = substrings.substring_dedup(docs, 8, 3)
    gone = F.aggregate(F.transform("removed", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    got = got.withColumn("n", gone).collect()
    # texts of one id stand in the order of a hash: take the order that the result shows
    order = documents(rows)
    options = [order]
    for i in (99, 2**63 - 1):
        pair = [d for d in order if d[0] == i]
        options += [[d for d in o if d[0] != i] + pair[::-1] if i != 99 else [x for o2 in [[d for d in o if d[0] < i], pair[::-1], [d for d in o if d[0] > i]] for x in o2] for o in options]
    results = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n, r.kept) for r in got)
    wants = []
    for o in options:
        w = brute_later(o, 8)
        wants.append(sorted((2**63 - 1 if i is None else i, *w[2**63 - 1 if i is None else i, t or ""]) for i, t, _ in rows))
    assert results in wants


def test_substrings_empty(empty):
    assert substrings.substring_dedup(empty).count() == 0


# 6 decontamination


def brute_hits(texts, items, width=10):
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for t in texts:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    found |= windows[g]
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def brute_longest(text, items, width=10):
    """The most consecutive words that the text shares with each item, where a window of it occurs."""
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOW))
    a, out = words(text), {}
    for i, t in items:
        b = words(t)
        before, most = [0] * (len(b) + 1), 0
        for x in a if b else ():
            before = [0] + [before[k] + 1 if x == y else 0 for k, y in enumerate(b)]
            most = max(most, *before)
        if b and most >= min(width, len(b)):
            out[i] = max(out.get(i, 0), most)
    return out


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 3])
def test_decontamination(spark, docs, rows, block):
    items = [("1", " ".join(rows[0][1].split(" ")[3:20])), ("2", "ONE, two!"), ("3", None), ("4", "..."), ("5", "w1"), ("5", rows[5][1][:200]), ("6", "é漢字 " * 12)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id string, text string, spans string")
    want = [(i, *x) for (i, _, _), x in zip(rows, brute_hits([t for _, t, _ in rows], items), strict=True)]
    got = decontam.contamination(docs, bench, block)
    n = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    same(got.withColumn("n_hit", n), want, "doc_id", "n_words", "n_hit", "items")
    longest = {(i, x): n for i, t, _ in rows for x, n in brute_longest(t, items).items()}
    found = got.collect()
    for r in found:
        assert [m.item for m in r["matches"]] == r["items"]
    assert sorted((m.length for r in found for m in r["matches"])) == sorted(n for i, t, _ in rows for n in brute_longest(t, items).values())
    low = lambda t: ALNUM_WORD.findall((t or "").translate(LOW))
    for r in found:
        texts = [low(t) for i, t, _ in rows if i == r.doc_id and len(low(t)) == r.n_words]
        for m in r["matches"]:
            n = slice(m.start, m.start + m.length), slice(m.item_start, m.item_start + m.length)
            assert any(w[n[0]] == low(t)[n[1]] != [] for w in texts for i, t in items if i == m.item)
    by_item = {r.item: r for r in decontam.longest_by_item(got).collect()}
    assert set(by_item) == {x for _, x in longest}
    for item, r in by_item.items():
        assert r.length == max(n for (_, x), n in longest.items() if x == item)
        assert r.n_docs == sum(x == item for _, t, _ in rows for x in brute_longest(t, items))
    clean = decontam.decontaminate(docs, bench, block)
    assert clean.columns == docs.columns
    same(clean, [(i,) for i, _, h, _ in want if not h], "doc_id")


def test_decontamination_empty(spark, empty, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty, none).count() == 0
    assert decontam.decontaminate(docs, none).count() == len(rows)


# 7 near duplicates


def brute_components(rows, percent=75):
    sets = []
    for _, t, _ in rows:
        w = SPACE_WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))})
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = [2**63 - 1 if i is None else i for i, _, _ in rows]
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(ids[k], len(sets[k]), least[find(k)]) for k in range(len(rows))]


@pytest.mark.parametrize("rests, values", [(near_dedup.RESTS, anchors.MOST_VALUES), (1, 0)])
def test_near_duplicates(docs, rows, monkeypatch, rests, values):
    monkeypatch.setattr(near_dedup, "RESTS", rests)
    monkeypatch.setattr(anchors, "MOST_VALUES", values)
    got = near_dedup.near_duplicates(docs)
    same(got, brute_components(rows), "id", "n_shingles", "component")


def test_near_duplicates_of_many_kinds_in_one_band(spark):
    rng = random.Random(5)
    out = []
    for k in range(120):  # chains of edits: neighbours are alike, ends are not
        if k % 12 == 0:
            words = [f"v{rng.randrange(9999)}" for _ in range(90)]
        words = list(words)
        for _ in range(2):
            words[rng.randrange(90)] = f"v{rng.randrange(9999)}"
        out.append((k, " ".join(words), None))
    df = spark.createDataFrame(out, "doc_id long, text string, source string")
    same(near_dedup.near_duplicates(df), brute_components(out), "id", "n_shingles", "component")


def test_keep_one(docs, rows, spark):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    comps = brute_components(rows)
    # no two components of this corpus have the same smallest id, but for that of no id: one text stays of each that is not alone
    want = [i for (i, _, _), (k, n, c) in zip(rows, comps, strict=True) if k == c and (n == 0 or i is None)]
    want += sorted({i for (i, _, _), (k, n, c) in zip(rows, comps, strict=True) if k == c and n > 0 and i is not None})
    want += [99]  # one id, two texts that are not alike: both stay
    same(kept, [(i,) for i in want], "doc_id")
    # without ids, and with repeated rows: one of each group
    text = " ".join(f"t{k}" for k in range(40))
    other = " ".join(f"u{k}" for k in range(40))
    odd = [(None, text, "a"), (None, text + " end", "b"), (None, other, "c"), (None, other, "c"), (1, other + " end", "d"), (1, other + " end", "d"), (2, "", "e"), (2, "", "e"), (3, None, "f")]
    left = near_dedup.keep_one(spark.createDataFrame(odd, "doc_id long, text string, source string")).collect()
    assert sorted(map(repr, ((r.doc_id, r.source) for r in left if r.doc_id is not None))) == sorted(map(repr, [(1, "d"), (2, "e"), (2, "e"), (3, "f")]))
    assert len([r for r in left if r.doc_id is None]) == 1


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {(r.u, r.v) for r in got.collect()} == {(k, 0) for k in range(1, 41)} | {(k, 100) for k in range(101, 130)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    bits = lambda a, b: int(np.unpackbits((near_dedup.odd_sketch(near_dedup.samples(a)) ^ near_dedup.odd_sketch(near_dedup.samples(b))).view(np.uint8)).sum())
    assert bits(whole, whole) == 0 and bits(whole[:900], whole) < bits(whole[:600], whole) < bits(whole[:100], whole[500:])
    assert bits(whole[:750], whole) < near_dedup.SKETCH_MOST < bits(whole[:550], whole)


# 8 lines


@pytest.mark.parametrize("least", [2, 3])
def test_lines(docs, rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    number = lambda i: 2**63 - 1 if i is None else i
    holders = collections.defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(number(i))
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < least or number(i) == min(holders[key(x)])]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = line_dedup.line_dedup(docs, min_docs=least)
    same(got, want, "doc_id", "n_lines", "n_dropped", "text")
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]


def test_lines_leave_other_columns_as_they_are(spark):
    names = ["_id", "_hash", "_text", "_drop", "_row", "_pos", "_line", "_k1", "_first"]
    rows = [(k, "a line of all documents\nown line %d" % k, *(f"{n} {k}" for n in names)) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.line_dedup(df).orderBy("doc_id")
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    for r, want in zip(got.collect(), rows, strict=True):
        assert tuple(r[n] for n in names) == want[2:] and r.n_dropped == int(r.doc_id > 0)


def test_only_ascii_letters_are_folded(spark):
    lines = ["Äpfel UND Birnen", "Äpfel und BIRNEN", "äpfel und birnen", "İstanbul is far", "i̇stanbul is far", "ΟΔΟΣ and more", "ΟΔΟΣ AND MORE", "οδος and more", "\u212aelvin or kelvin", "kelvin or kelvin", "ẞ and ss, ﬁ and fi", "ß AND ss, ﬁ and fi"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()} == {k: int(k in (1, 6)) for k in range(len(lines))}
    swapped = ["\u212a and k is a long line", "k and \u212a is a long line", "K AND \u212a is a long line", "\u0130 and i\u0307 is long", "i\u0307 and \u0130 is long", "\u212b and \u00e5 is long", "\u00e5 and \u212b is long"]
    df = spark.createDataFrame(list(enumerate(swapped)), "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(df).collect()} == {k: int(k == 2) for k in range(len(swapped))}


@pytest.mark.parametrize("share", [0, 1])
def test_lines_that_are_hot_or_not(docs, monkeypatch, share):
    want = line_dedup.line_dedup(docs).collect()
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    same(line_dedup.line_dedup(docs), [tuple(r) for r in want], *docs.columns, "n_lines", "n_dropped")


def test_lines_empty(empty):
    assert line_dedup.line_dedup(empty).count() == 0


# 9 classifier


def labelled(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "house", "tree", "runs", "slowly", "of"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "click", "|"]) for _ in range(40))
    data = [(k, bad() if k % 4 == 0 else good(), int(k % 4 != 0)) for k in range(300)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in data] + [(900, None, "x"), (901, "", "x"), (None, "the", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in data] + [(5, None, 0), (None, 1, 0), (77_777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {k: q for k, _, q in data}


def test_classifier_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    weights = quality_model.fit(docs, labels)
    got = quality_model.score(docs, weights).withColumn("out", quality_model.held_out()).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        if r.doc_id is not None:
            assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.out and r.doc_id in truth]
    assert len(held) > 30 and all((r.score >= quality_model.THRESHOLD) == truth[r.doc_id] for r in held)
    kept = quality_model.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {k for k, q in truth.items() if q}


def test_features_and_training_against_plain_versions():
    from boxquery.llm._common import text_bytes
    from boxquery.llm._text import BASES, prefix_hash, span_hash
    import pyarrow as pa

    full = 2**64 - 1

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & full
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & full
        return h ^ h >> 31

    def plain(text, bits):
        tokens = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t\n\x0b\x0c\r]+", text)
        number = lambda t: int(span_hash(prefix_hash(np.frombuffer(t, np.uint8), BASES[0]), np.array([0]), np.array([len(t)]), BASES[0])[0])
        caps = [len(re.findall(rb"[A-Z]", t)) for t in tokens]
        kind = [(1 if c > 1 and 2 * c > len(t) else 2 if c else 0) if re.match(rb"[A-Za-z\x80-\xff]", t) else 4 if t[:1].isdigit() else 5 for t, c in zip(tokens, caps, strict=True)]
        h, n = [number(t) for t in tokens], len(tokens)
        out = set(h) | {mixed((h[k] * 3 + h[k + 1]) & full) for k in range(n - 1)} | {mixed(s + 1_000_003) for s in kind}
        out |= {mixed(kind[k] * 64 + kind[k + 1] + 2_000_003) for k in range(n - 1)} | {mixed(3_000_003) for k in range(n - 2) if tokens[k] == tokens[k + 1] == tokens[k + 2]}
        return {x & (1 << bits) - 1 for x in out}

    texts = ["The CAT  sat, the cat sat 42!!", "", "no no no No", "é漢 x9y\t--", "BUY now"]
    at, offsets = quality_model.features(*text_bytes(pa.array(texts)), 12)
    rows = [at[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [set(r.tolist()) for r in rows] == [plain(t.encode(), 12) for t in texts]

    labels, alpha, beta, l1, l2 = np.array([1.0, 0.0, 1.0, 1.0, 0.0]), 5.0, 1.0, 0.1, 0.01
    got = quality_model.train_ftrl(rows, labels, 12, steps=30, l1=l1)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else ((l1 if z[i] > 0 else -l1) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)
    more = {1.0: max(1.0, (2 / 3) ** 0.5), 0.0: max(1.0, (3 / 2) ** 0.5)}
    order = np.random.default_rng(0)
    for _ in range(6):
        for k in order.permutation(5):
            x = {int(i): 1 / max(len(rows[k]), 1) ** 0.5 for i in rows[k]} | {1 << 12: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - labels[k]) * more[labels[k]] * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range((1 << 12) + 1)])
    one_by_one = [quality_model.scores(got, r, np.array([0, len(r)]))[0] for r in rows]
    assert quality_model.scores(got, at, offsets).tolist() == one_by_one


def test_classifier_learns_nothing_from_held_out_labels(spark):
    docs, labels, _ = labelled(spark)
    other = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_model.fit(docs, labels), quality_model.fit(docs, other))


def test_classifier_without_labels(spark, empty, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score(docs, quality_model.fit(docs, none)).count() == len(rows)
    assert quality_model.score(empty, quality_model.fit(empty, none)).count() == 0


# 10 rules


def brute_rules(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = collections.Counter(windows)
    again = {p for k, w in enumerate(windows) if count[w] > 1 for p in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed)


def test_rules(docs, rows):
    got = quality_rules.host_verdicts(docs)
    want = [(i, s, *brute_rules(t)) for i, t, s in rows]
    same(got, want, "doc_id", "host", *quality_rules.COUNTS, "base_failed")
    hosts = collections.defaultdict(list)
    for w in want:
        if w[1] is not None:
            hosts[w[1]].append(w[-1])
    n = sum(map(len, hosts.values()))
    m = sum(map(sum, hosts.values())) / n
    spread = sum(sum(v) ** 2 / len(v) for v in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n
    s = min(1000.0, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1000.0
    rate = {h: (sum(v) + m * s) / (len(v) + s) for h, v in hosts.items()}
    same(got, [(w[0], w[1], not w[-1] and rate.get(w[1], 0) <= quality_rules.HOST_RATE) for w in want], "doc_id", "host", "kept")


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"x{k}" for k in range(80))
    docs = spark.createDataFrame([(k, good if k % 20 == 0 else "bad", "spam") for k in range(100)] + [(100 + k, good, f"h{k % 5}") for k in range(300)], "doc_id long, text string, source string")
    got = quality_rules.host_verdicts(docs)
    assert got.where("kept and host = 'spam'").count() == 0 and got.where("kept").count() == 300


def test_rules_empty(empty):
    assert quality_rules.host_verdicts(empty).count() == 0


# shared parts


def test_written_reads_back_the_same_rows(spark):
    df = spark.range(10).withColumn("x", F.lit(None).cast("string"))
    assert sorted(map(tuple, written(df, "t").collect())) == sorted(map(tuple, df.collect()))


def test_winnowed_windows_choose_alike():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    seeds = np.concatenate([rng.integers(0, 1 << 63, 57, dtype=np.uint64), base, rng.integers(0, 1 << 63, 31, dtype=np.uint64), base])
    got = anchors.winnow(seeds, np.array([0, len(seeds)]), 40, 1)
    at = np.repeat(got.anchor, got.windows)
    assert (at[57 : 57 + 261] == at[57 + 331 : 57 + 331 + 261]).all()


def test_transducer_forgets(monkeypatch):
    """Texts of ever new pieces, and pieces longer than a chunk, with few emissions kept."""
    monkeypatch.setattr(token_counts, "KEPT_EMISSIONS", 50)
    transducer = token_counts._transducer("piece_bpe_32k.model")
    texts = [" ".join(f"n{k * j}" for j in range(40)) + "\n" + "ab" * 9000 + " " + "é" * 8192 + "\n\n" for k in range(1, 6)]
    assert transducer.counts(texts) == [len(transducer.library.encode(t)) for t in texts]


# 11 importance resampling


def brute_importance(rows, target, most, buckets, seed, percent, min_words):
    def features(text):
        w = ALNUM_WORD.findall((text or "").translate(LOW))
        return [" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for text in texts for f in features(text)[0]) for texts in ([x for _, x, _ in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text, _ in rows:
        found, n = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(*r, k) for k, r in enumerate(able[: percent * len(able) // 100], 1)]
    return ranks + [(*r, None) for r in able[len(ranks) :]] + [(*r, None) for r in out if r[1] < min_words]


@pytest.mark.parametrize("most, percent, span", [(1, 10, 1 << 21), (2, 45, 300), (3, 100, 1 << 21)])
def test_importance(spark, docs, rows, monkeypatch, most, percent, span):
    monkeypatch.setattr(importance, "BLOCK_BYTES", span)
    target = [rows[1][1], None, "", "W1 w2, é漢字 w3", rows[5][1]]
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resample(docs, wanted, most=most, buckets=50, seed=7, percent=percent, min_words=20)
    same(got, brute_importance(rows, target, most, 50, 7, percent, 20), "doc_id", "n_words", "n_features", "weight", "score", "rank")


def test_importance_of_empty_tables(spark, docs, empty, rows):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(empty, nothing).count() == 0
    got = importance.resample(docs, nothing, buckets=50, seed=7)
    same(got, brute_importance(rows, [], 1, 50, 7, 10, 20), "doc_id", "n_words", "n_features", "weight", "score", "rank")


# 12 filter audit


def brute_audit(rows, good, toxic):
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t, _ in rows:
        least[t or ""] = min(least.get(t or "", (True, 1)), key(i))
    docs = collections.defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key(i) > least[t]}
        docs[part or ""].append(({k for k, v in failed.items() if v}, i in good, i in toxic))
    out = []
    for part, found in docs.items():
        shapley, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(removed)
                lines.append((f, ("".join(order), step, len(left), len(removed), sum(f in d[0] for d in found) - len(removed), sum(d[0] == {f} for d in found), sum(d[1] for d in removed), sum(d[2] for d in removed))))
        out += [(part, *line, shapley[f]) for f, line in lines]
    return out


@pytest.mark.parametrize("most, collide", [(filter_audit.BROADCAST_FINGERPRINTS, False), (0, False), (0, True)])
def test_filter_audit(spark, docs, rows, monkeypatch, most, collide):
    monkeypatch.setattr(filter_audit, "BROADCAST_FINGERPRINTS", most)
    if collide:  # all texts have one of three fingerprints: the chains part them
        monkeypatch.setattr(filter_audit.F, "xxhash64", lambda c: F.length(c).cast("long") % 3)
    odd = [(200 + k, "UPPER " * 250 + "a#b" * (k % 2), "s1") for k in range(4)] + [(300, rows[60][1], "s2"), (5, rows[60][1], "s2"), (5, rows[60][1], None)]
    more = spark.createDataFrame([(i, t, s, "en", 0, 1, "x", "x", "x", "x", "x", "x") for i, t, s in odd], docs.schema)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (60, 1, 1), (61, None, 1), (83, 1, 0), (99, 1, 1), (None, 1, 1), (201, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs.unionByName(more).repartition(7), labels)
    same(got, brute_audit(rows + odd, {1, 60, 83, 99}, {60, 61, 99, 201}), *filter_audit.RESULT.replace(" string", "").replace(" long", "").replace(" int", "").split(", "))


def test_filter_audit_empty(spark, empty):
    assert filter_audit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 13 best-fit packing


def brute_best_fit(lengths, size):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(size - n)
        else:
            room[room.index(fit)] -= n
    return len(room)


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(docs, rows, size):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    got = packing.pack(docs, size).cache()
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
    same(got, want, "doc_id", "piece", "start", "length", "ids_crc32", "ids")
    places = collections.defaultdict(list)
    for r in got.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= size
    assert len(places) == brute_best_fit([w[3] for w in want], size)
    joined = packing.sequences(got).collect()
    assert sorted(len(r.ids) for r in joined) == sorted(sum(n for _, n in p) for p in places.values())
    assert sum(sum(r.ids) for r in joined) == sum(sum(w[5]) for w in want)


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_the_plan_is_best_fit_over_counts():
    rng = random.Random(3)
    for size in (7, 30, 100):
        for _ in range(40):
            counts = {rng.randrange(1, size + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 20))}
            runs = packing.plan(counts, size)
            assert len(runs) <= 4 * size * size.bit_length()
            used, ranks = collections.defaultdict(list), collections.defaultdict(set)
            for length, first, n, each, sequence, at in runs:
                for k in range(n):
                    used[sequence + k // each].append((at + k % each * length, length))
                    ranks[length].add(first + k)
            assert ranks == {n: set(range(c)) for n, c in counts.items()}
            assert all(sorted(p) == list(zip([0, *itertools.accumulate(n for _, n in sorted(p))], (n for _, n in sorted(p)), strict=False)) for p in used.values())
            assert len(used) == brute_best_fit([n for n, c in counts.items() for _ in range(c)], size)


def test_both_token_libraries_read_every_character_alike():
    encoder = packing.Encoder()
    assert encoder.fast is not None
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}{c}. " for c in chars[k : k + 2000]) for k in range(0, len(chars), 2000)]
    texts += ["<|endoftext|>x<|endoftext|> \n <|endoftext", "it's  they'LL\t\t x\u00a0y \r\n", " " * 5000 + "x", "ab" * 5000, ""]
    assert [encoder.ids(t) for t in texts] == [e.ids for e in encoder.plain.encode_batch(texts, add_special_tokens=False)]
