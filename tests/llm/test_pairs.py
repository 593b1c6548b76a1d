"""op1, op6, op7, op9 against brute force, and their edge cases."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import common, graph, op1_jaccard, op6_topk, op7_winnowing, op9_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Rows (doc_id, text), with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], "doc_id bigint, text string, label string, id bigint, n bigint, key string")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def vary(rng, words, rate):
    return " ".join(w if rng.random() > rate else rng.choice(words) for w in words)


# op1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard_truth(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 6, 8, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 9])):
            rows.append(vary(rng, base, rng.choice([0, 0.005, 0.02, 0.05])) + (" " + shared if rng.random() < 0.3 else ""))
    rows += ["", None, "  \t\n", "one", "ONE", "one two\x0bthree", "Ünï çode a b c d", "É a b c d e", "é a b c d e", " ".join(rng.choices(vocabulary, k=30_000))]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1_jaccard.components(docs_of(spark, rows)).collect()}
    assert got == jaccard_truth(rows)


def test_jaccard_chain_and_repeats(spark):
    """Links in a chain whose ends do not link; null ids and repeated rows."""
    words = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(20)]
    assert {r.component_id for r in op1_jaccard.components(docs_of(spark, rows)).collect()} == {0}
    got = op1_jaccard.components(docs_of(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A B C D E F")])).collect()
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got], key=str) == sorted([(False, 5, 2, 2), (False, 5, 2, 2), (True, 0, 2, 2), (True, 0, 0, None), (False, 2, 2, 2)], key=str)
    assert op1_jaccard.components(docs_of(spark, [])).collect() == []


def test_jaccard_parts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300), np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, rng.integers(1, 900), np.uint64)])
        assert op1_jaccard.differing_bits(op1_jaccard.bitmap(a), op1_jaccard.bitmap(b)) <= len(np.setxor1d(a, b))
    for n in range(1, 200):
        for m in range(n, 200):
            if 100 * n >= 75 * m:  # prefixes of every overlap that suffices reach a common element
                o = op1_jaccard.needed_overlap(n, m)
                assert op1_jaccard.prefixes(n)[0] >= n - o + 1 and op1_jaccard.prefixes(m)[1] >= m - o + 1
    size = np.array([10, 10, 12, 14, 40])
    found = {p for u, v in op1_jaccard.tile_pairs(np.arange(5), np.array([0, 1, 2, 2, 3]), size, np.ones(5, bool), band=2) for p in zip(u.tolist(), v.tolist())}
    assert found == {(0, 1), (0, 2), (1, 2)}


def test_tiles_with_bitmaps_and_earlier_shingles():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 120, np.uint64)
    sets = []
    for _ in range(60):
        kept = base[rng.random(120) > rng.choice([0.02, 0.1, 0.25])]
        sets.append(np.unique(np.r_[kept, rng.integers(1, 1 << 62, rng.integers(1, 30), np.uint64)]))
    linked = {(i, j) for i in range(60) for j in range(i + 1, 60) if (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert linked
    keys = [s[: op1_jaccard.prefixes(len(s))[1]].view(np.int64) for s in sets]
    plain, lean, bounded = Counter(), Counter(), Counter()
    for key in sorted({k for ks in keys for k in ks.tolist()}):
        at = {i: ks.tolist().index(key) for i, ks in enumerate(keys) if key in ks}
        rep = np.array(list(at))
        size = np.array([len(sets[i]) for i in rep])
        short = np.array([at[i] < op1_jaccard.prefixes(len(sets[i]))[0] for i in rep])
        before = np.array([[keys[i][at[i] - 1 - k] if at[i] > k else key for k in range(op1_jaccard.BEFORE)] for i in rep])
        bits = np.array([op1_jaccard.bitmap(sets[i]) for i in rep], object)
        for into, options in ((plain, {}), (lean, {"key": key, "before": before}), (bounded, {"bits": bits, "key": key, "before": before})):
            for u, v in op1_jaccard.tile_pairs(rep, rep, size, short, band=16, **options):
                into.update(zip(u.tolist(), v.tolist()))
    assert set(plain) == set(lean) and lean.total() < plain.total() / 2
    assert linked <= set(bounded) < set(plain)


def test_tiles_are_dealt(spark):
    """Each pair of fitting sizes meets in exactly one tile, and no tile is much larger than asked for."""
    rng = random.Random(8)
    rows = [(key, i + 10_000 * key, i % 7, 2 * rng.randint(3, 60) + i % 2) for key, n in ((1, 400), (2, 9), (3, 60), (4, 30)) for i in range(n)]
    rows = [(k, i, 0 if k == 4 else a, s) for k, i, a, s in rows]  # one label only: no pair
    got = op1_jaccard._dealt(spark.createDataFrame(rows, "key bigint, id bigint, label bigint, size bigint"), 16).collect()
    tiles = {}
    for r in got:
        tiles.setdefault((r.key, r.tile), ([], []))[r.side].append(r)
    assert max(len(a) + len(b) for a, b in tiles.values()) < 90
    met = Counter()
    for a, b in tiles.values():
        for x, y in itertools.product(a, b) if b else itertools.combinations(a, 2):
            met[min(x.id, y.id), max(x.id, y.id)] += 1
    size = {i: s // 2 for _, i, _, s in rows}
    label = {i: k for k, i, _, _ in rows}
    wanted = {(i, j) for i, j in itertools.combinations(sorted(size), 2) if label[i] == label[j] < 4 and 4 * min(size[i], size[j]) >= 3 * max(size[i], size[j])}
    assert wanted <= set(met) and set(met.values()) == {1}


def test_one_shingle_in_many_classes(spark):
    """A shingle that thousands of unlinked classes have in their prefixes, beside linked pairs of them."""
    rng = random.Random(9)
    rows = [(i, "the one common start " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(4))) for i in range(6000)]
    rows += [(10_000 + i, t + " " + rows[i + 1][1].split()[-1]) for i, t in rows[:40]]
    got = {r.doc_id: r.component_id for r in op1_jaccard.components(docs_of(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, 10_000 + i) for i in range(40) if 100 * len(sets[i] & sets[10_000 + i]) >= 75 * len(sets[i] | sets[10_000 + i])]
    assert links and got == components(sets, links)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    got = op1_jaccard.components(docs_of(spark, [(3, a), (5, a), (5, b), (7, b), (9, b + " c"), (11, "x y")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 3), (11, 11)]


def test_matches_sql(spark, sf_dir, same_rows):
    same_rows(op1_jaccard.op1_ngram_jaccard_join(spark, sf_dir), op1_jaccard.SQL)


# components


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)] + [(7, 7)]
    got = {r.id: r.label for r in graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_id_filter(spark):
    ids = spark.range(0, 5000, 7)
    passed = spark.range(5000).where(common.id_filter(ids, "id")(F.col("id")))
    assert passed.where("id % 7 = 0").count() == ids.count()
    assert passed.count() < ids.count() + 50


# op6


@pytest.mark.parametrize("bits,k,n", [(64, 10, 400), (32, 3, 900), (16, 5, 60), (64, 10, 4)])
def test_topk(spark, bits, k, n):
    rng = np.random.default_rng(bits + n)
    centres = rng.normal(size=(8, bits))
    v = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, bits)) * 0.5
    v[1] = v[0]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([*rows, (n, None), (n + 1, [1.0]), (None, rows[0][1])], "vec_id bigint, embedding array<float>").repartition(3)
    data = op6_topk.codes(df, bits=bits)
    queries = data.where("id % 20 = 0")
    for options in ({}, {"block": 3}, {"slice_rows": 50}):
        got = {(r.query_id, r["rank"]): (r.distance, r.vec_id) for r in op6_topk.topk(data, queries, k, bits, **options).collect()}
        s = v > 0
        want = {}
        for q in range(0, n, 20):
            best = sorted((int((s[q] != s[i]).sum()), i) for i in range(n))[:k]
            want |= {(q, j + 1): x for j, x in enumerate(best)}
        assert got == want


@pytest.mark.parametrize("n", [1, 2, 37, 2000, 20_000])
def test_index_ends_by_coverage(n):
    """Every query's radius stops where its kth distance is covered, short of the whole slice; random codes are the worst case."""
    rng = np.random.default_rng(n)
    data = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + rng.integers(0, 2, n, np.uint64)
    ids = rng.permutation(n)
    index = op6_topk.Index(ids, data)
    q, p, d, covered = index.search(data[:100], 10)
    for i in range(min(100, n)):
        away = np.bitwise_count(data ^ data[i]).astype(int)
        best = np.lexsort((ids, away))[:10]
        assert p[q == i].tolist() == best.tolist() and d[q == i].tolist() == away[best].tolist()
        assert n < 10 or away[best[-1]] <= covered[i] < 40


def test_topk_repeated_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in r] for r in rng.normal(size=(30, 64))]
    rows = [(i, x) for i, x in enumerate(v)] + [(0, v[0]), (0, v[5]), (7, v[7])]
    data = op6_topk.codes(spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id bigint, embedding array<float>, code int, b int"))
    got = op6_topk.topk(data, data.where("id = 0"), 4).collect()
    bits = lambda x: [y > 0 for y in x]
    away = lambda a, b: sum(x != y for x, y in zip(bits(a), bits(b)))
    want = [(r + 1, d, i) for c in (v[0], v[5]) for r, (d, i) in enumerate(sorted((away(c, x), i) for i, x in rows)[:4])]
    assert sorted((r["rank"], r.distance, r.vec_id) for r in got) == sorted(want)


def test_topk_empty_and_sql(spark, sf_dir, same_rows):
    data = op6_topk.codes(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert op6_topk.topk(data, data).collect() == []
    same_rows(op6_topk.op6_exact_topk(spark, sf_dir), op6_topk.SQL)


# op7


def hits_truth(docs, items, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    out = []
    for i, t in docs:
        w, hit, met = cut(t), set(), set()
        for item, it in items:
            x = cut(it)
            n = min(len(x), span)
            if not n:
                continue
            windows = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    met.add(str(item))
        out.append((i, len(w), len(hit), len(met), ",".join(sorted(met))))
    return sorted(out, key=str)


def test_winnowing(spark):
    import hashlib

    rng = random.Random(9)
    vocabulary = [f"t{k}" for k in range(60)] + ["é", "É", "x"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([10, 11, 14, 30, 60, 9, 3, 1, 0, 25])] + [(10, None), (11, "same same same same same same same same same same same same"), (12, items_text := "Aa Bb, cc-dd ee.ff gg hh ii jj kk ll mm")]
    docs = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 9, 40, 200]))
        for _ in range(rng.choice([0, 1, 2])):
            x = rng.choice(items)[1]
            x = (x or "").split()
            a = rng.randrange(max(1, len(x)))
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[a : a + rng.choice([8, 9, 10, 11, 40])]
        docs.append((k, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "same " * 9), (103, "SAME " * 10), (104, "z " + items_text.upper() + " z"), (105, "x"), (105, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = op7_winnowing.judge(docs_of(spark, docs), bench).collect()
    want = hits_truth(docs, items)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got], key=str) == sorted([(*x[:4], hashlib.sha256(x[4].encode()).hexdigest()) for x in want], key=str)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f g h i j k")]), ([(1, "a b c")], []), ([(None, "a b c d e f g h i j k"), (None, None)], [(None, "a b c d e f g h i j k")])])
def test_winnowing_edges(spark, docs, items):
    got = op7_winnowing.judge(docs_of(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(got) == len(docs)
    assert sum(r.contaminated for r in got) == (1 if docs and docs[0][0] is None else 0)


def test_winnowing_large_benchmark(spark, sf_dir, same_rows, monkeypatch):
    """The same rows when nothing may be broadcast."""
    monkeypatch.setattr(op7_winnowing, "small", lambda df, limit=0: False)
    same_rows(op7_winnowing.op7_decontamination(spark, sf_dir), op7_winnowing.SQL)


def test_short_items_in_long_documents(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(rng.choices(words, k=1 + k % 9))) for k in range(40)] + [(99, "w1")]
    rows = [(k, " ".join(rng.choices(words + ["x"], k=n))) for k, n in enumerate([20_000, 20_000, 300, 5, 0])]
    rows += [(10, "w3"), (10, "w1 w2")]
    got = op7_winnowing.judge(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = []
    for i, t in rows:
        w, hit, found = t.split(), set(), 0
        for _, x in items:
            x = x.split()
            at = [p for p in range(len(w) - len(x) + 1) if w[p : p + len(x)] == x]
            found += bool(at)
            hit.update(p + q for p in at for q in range(len(x)))
        want.append((i, len(w), len(hit), found))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted(want)


# op9


def normal(line):
    return re.sub(r"[\x00-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")


def simhash(words):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_hashes(x, y, blocks=op9_lines.HAMMING + 2):
    z = x ^ y
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return bin(z).count("1") <= op9_lines.CLOSE and sum(z >> a & (1 << b - a) - 1 == 0 for a, b in itertools.pairwise(cuts)) >= 2


def lines_truth(rows, percent=90, least=1):
    places = {}
    for i, t in rows:
        if i is None or t is None:
            continue
        for k, line in enumerate(t.split("\n")):
            n = normal(line)
            if len(n.split(" ")) >= least and n:
                places.setdefault(n, set()).add((i, k))
    texts = list(places)
    marks = [simhash(t.split(" ")) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near_hashes(marks[a], marks[b]) and distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])) * (100 - percent) // 100]
    comp = components(range(len(texts)), links)
    first = {}
    for k, t in enumerate(texts):
        first[comp[k]] = min([*places[t], first.get(comp[k], (1 << 62, 0))])
    gone = {p for k, t in enumerate(texts) for p in places[t] if p != first[comp[k]]}
    return [(i, t if t is None or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows], len(links)


def test_lines(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "abdl" for b in "aeo" for c in "nrst"] + ["élan", "Über"]
    bases = [rng.choices(vocabulary, k=n) for n in (3, 5, 20, 60, 150)]
    pool = [" ".join(b) for b in bases]
    for b in bases[2:]:
        for _ in range(12):
            x = list(b)
            for _ in range(rng.choice([1, 1, 2])):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            pool.append(" ".join(x))
    pool += ["", "two words", "All rights, reserved 2020!", "all RIGHTS reserved (2021).", "12345 67"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.choice([1, 3, 6])) + [" ".join(rng.choices(vocabulary, k=25))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, rows[3][1]), (None, rows[3][1])]
    got = {r.doc_id: r.text for r in op9_lines.dedup(docs_of(spark, rows)).select("row.*").collect()}
    want, n_links = lines_truth(rows)
    assert n_links > 20
    assert got == dict(want)


def test_long_line_bits(spark):
    """Lines beyond the packed sums have the same SimHash by the slow way."""
    rng = random.Random(2)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    text = rng.choices(words, k=40_000)
    classes = spark.createDataFrame([(1, 1, " ".join(text)), (2, 2, "only three words")], "h1 bigint, h2 bigint, words string")
    got = {r.h1: r.simhash & (1 << 64) - 1 for r in op9_lines.simhashes(classes).collect()}
    assert got == {1: simhash(text), 2: simhash(["only", "three", "words"])}


def test_lines_edges(spark):
    assert op9_lines.dedup(docs_of(spark, [])).collect() == []
    got = op9_lines.dedup(docs_of(spark, [(1, "a b c\na b c"), (1, "a b c\na b c"), (2, "a b c")])).select("row.doc_id", "row.text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, "a b c", 2, 1), (1, "a b c", 2, 1), (2, "", 1, 1)]
    odd = spark.createDataFrame([(1, "Share this\nShare this", 7, 8, 9, 1), (2, "1 2\nshare THIS\n1 2", 7, 8, 9, 2)], "doc_id bigint, text string, `lines` int, gone int, n_lines int, row int")
    got = op9_lines.dedup(odd, minima=12).select("row.*").collect()
    assert sorted(map(tuple, got)) == [(1, "Share this", 7, 8, 9, 1), (2, "1 2\n1 2", 7, 8, 9, 2)]


def test_many_unlinked_lines_in_one_key(spark):
    """Lines that share a SimHash and a length, so that all meet, but are not alike; and a few that are."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample([f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"], 12))) for i in range(300)]
    rows += [(1000 + i, rows[i][1][:-1] + "z") for i in range(30)]
    lines = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc bigint, line int, words string").selectExpr("doc", "line", "xxhash64(words) as h1", "xxhash64(words, 1) as h2", "length(words) as size", "words")
    classes = lines.selectExpr("h1", "h2", "0L as simhash", "size", "array(1L) as keys")
    found, compared = op9_lines.links(lines, classes, 2, 90)
    groups = graph.connected_components(found).join(compared, "id").join(lines, ["h1", "h2"]).select("doc", "label").collect()
    label = {r.doc: r.label for r in groups}
    texts = dict(rows)
    want = components(texts, [(a, b) for a, b in itertools.combinations(texts, 2) if distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])) // 10])
    for a, b in itertools.combinations(texts, 2):
        assert (want[a] == want[b]) == (a in label and label.get(a) == label.get(b))


def test_lines_recall(spark, tmp_path):
    """Against edit similarity alone: lines of which words are replaced, put in, or misspelt, 90 % alike at least."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 11)))
    rows = []
    while len(rows) < 200:
        words = [word() for _ in range([8, 15, 30, 60][len(rows) // 50])]
        new = list(words)
        for _ in range(rng.choice([1, 1, 2, 3]) if len(words) < 60 else rng.randrange(1, len(words) // 12)):
            at = rng.randrange(len(new))
            new[at] = rng.choice([word(), new[at] + " " + word(), new[at][1:] + "x"])
        a, b = " ".join(words), " ".join(new)
        if a != b and distance(a, b) <= max(len(a), len(b)) // 10:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    docs_of(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    removed = {r.doc_id: r.n_removed for r in op9_lines.dedup(docs, minima=op9_lines.MINIMA).select("row.doc_id", "n_removed").collect()}
    assert all(removed[k] == 0 for k in range(0, 200, 2))
    assert sum(removed.values()) >= 0.95 * 100


@pytest.mark.parametrize("few", [0, 10**6])
def test_chosen_pairs(spark, monkeypatch, few):
    """Components of all links, for which pairs within what is linked already are not verified."""
    monkeypatch.setattr(graph, "FEW_PAIRS", few)
    rng = random.Random(4)
    group = {i: i // 40 if i < 120 else i for i in range(160)}
    alike = {(a, b) for a, b in itertools.combinations(group, 2) if group[a] == group[b] and (b - a == 1 or rng.random() < 0.7)}
    far = {(a, b) for a, b in itertools.combinations(group, 2) if group[a] != group[b] and rng.random() < 0.02}
    rows = [(a, b, rng.choice([0, 1])) for a, b in alike] + [(a, b, rng.choice([1, 2])) for a, b in far]
    asked = []

    def verified(some):
        asked.extend((r.u, r.v) for r in some.collect())
        return common.written(some.join(spark.createDataFrame(sorted(alike), "u bigint, v bigint"), ["u", "v"]))

    pairs = spark.createDataFrame(rows, "u bigint, v bigint, apart int")
    given = spark.createDataFrame([(0, 1), (40, 41)], "u bigint, v bigint")
    got = {r.id: r.label for r in graph.connected_components(graph.chosen(pairs, [given], verified)).collect()}
    want = components(group, sorted(alike))
    assert got == {i: want[i] for i in group if group[i] < 3}
    assert len(asked) == len(set(asked)) and {p for p in far} <= set(asked)
    if not few:
        assert len(asked) < len(far) + len(alike) / 3


def test_least_edits(spark):
    """Never more than the edit distance, and enough for a text of other letters."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etanirsohdlcuxé", k=rng.randrange(1, 9)))
    rows = [("eeee", "xxxx"), ("e" * 40_000, "e" * 40_010), ("ab", "ab")]
    while len(rows) < 120:
        a = " ".join(word() for _ in range(rng.randrange(1, 12)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b))] = rng.choice(["", "e", "x", " ", "é", "tt"])
        rows += [(a, "".join(b)), (a, " ".join(word() for _ in range(5)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    sides = [[c.alias(f"{s}{k}") for k, c in enumerate(op9_lines.counted(F.col(s)))] for s in "ab"]
    bound = op9_lines.least_edits(*[[F.col(f"{s}{k}") for k in range(3)] for s in "ab"])
    got = df.select("i", *sides[0], *sides[1]).select("i", bound.alias("least")).collect()
    for r in got:
        a, b = rows[r.i]
        assert r.least <= (10 if len(a) > 1000 else distance(a, b))
    assert {r.i: r.least for r in got}[0] == 4


@pytest.mark.parametrize("most", [1, 5])
def test_lines_of_large_and_small_places(spark, monkeypatch, most):
    """Meeting places above and below PAIRED, and rounds by component, give what brute force gives."""
    monkeypatch.setattr(op9_lines, "PAIRED", most)
    monkeypatch.setattr(graph, "FEW_PAIRS", 0)
    test_lines(spark)
