"""Operators 4, 5 and 8 against brute force and SQL."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from compare import rows_of
from pyspark.sql import functions as F

from rillstone.llm import line_dedup, order_minhash, simhash
from rillstone.llm.components import components

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def simhash_model(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, radius=3):
    """Least index of each fingerprint's component."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check_simhash(df, found):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    fps = [simhash_model(r.text) for r in rows]
    root = linked(fps)
    expected = sorted((str(r.doc_id), f, str(rows[root[i]].doc_id)) for i, (r, f) in enumerate(zip(rows, fps, strict=True)))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found.collect()) == expected


def test_op8(odd, clashing, nothing, documents):
    for df in (odd, clashing, documents):
        check_simhash(df, simhash.near_duplicates(df))
    check_simhash(documents, simhash.near_duplicates(documents, tile=3, crowd=5))
    assert simhash.near_duplicates(nothing).count() == 0


def test_op8_query(spark, sf, documents):
    for r in simhash.op8_simhash_near_duplicates(spark, sf).collect():
        assert len(r.fingerprint) == 16 and r.component_id <= r.doc_id
        assert int(r.fingerprint, 16) == simhash_model(documents.where(F.col("doc_id") == r.doc_id).first().text) if r.doc_id < 5 else True


@pytest.mark.parametrize("tile, crowd", [(8, 8), (5, 64), (simhash.TILE, simhash.CROWD)])
def test_links_of_many_fingerprints(spark, tile, crowd):
    """Random numbers, chains of near ones, and a bucket of very many."""
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base[:60]]
    chain = [base[0]]
    for _ in range(20):
        chain.append(chain[-1] ^ 0b111 << rng.randrange(60))
    many = [0xABCD << 48 | rng.getrandbits(14) for _ in range(200)]
    fps = sorted({*base, *near, *chain, *many, 0, (1 << 64) - 1}, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tile=tile, crowd=crowd)
    assert edges.count() < 40 * len(fps)
    roots = {r.node: r.root for r in components(edges).collect()}
    assert [roots.get(x, x) for x in signed] == [signed[i] for i in linked(fps)]


def runs_of(fps, bits=16):
    """The buckets of one block, as the operator sorts them."""
    run = fps >> np.uint64(64 - bits)
    order = np.lexsort((fps, np.bitwise_count(fps), run))
    return simhash.Runs(run[order].astype(np.int64), np.zeros(len(fps), np.int8), fps[order])


def test_tiles_are_skipped_by_population_count(spark):
    """On the fingerprints of a whole table, and on a bucket of many: every near pair of a bucket is
    joined, and tiles too far apart in population count are not compared."""
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.unique(np.array([r.fp for r in simhash.simhash(documents).collect()], np.int64).view(np.uint64))
    crowd = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 3000, np.uint64))
    for runs, least in ((runs_of(fps), 0.2), (runs_of(crowd), 0.3)):
        links = simhash.compare_tiles(runs, 3)
        assert links.compared > len(runs.fp) / simhash.TILE - 1
        neighbours = links.compared + links.skipped - -(-len(runs.fp) // simhash.TILE)  # pairs of two tiles
        assert links.skipped > least * neighbours
        member, root = simhash.forest(len(runs.fp), links.a, links.b)
        found = np.arange(len(runs.fp))
        found[member] = root
        expected = []
        for lo, hi in zip(*(lambda s: (s, [*s[1:], len(runs.fp)]))(np.flatnonzero(np.r_[True, runs.run[1:] != runs.run[:-1]]).tolist()), strict=True):
            expected += [lo + r for r in linked(runs.fp[lo:hi])] if hi - lo > 1 else [lo]
        assert found.tolist() == expected


def test_survivors(odd, nothing, documents):
    found = simhash.near_duplicates(documents).collect()
    kept = {r.doc_id for r in simhash.survivors(documents).collect()}
    assert kept == {r.component_id for r in found}
    odd_kept = sorted((r.doc_id for r in simhash.survivors(odd).collect()), key=str)
    assert odd_kept.count(9) == 1 and 4 not in odd_kept and 6 not in odd_kept and 2 in odd_kept
    assert simhash.survivors(nothing).count() == 0


def test_components(spark):
    rng = random.Random(1)
    nodes = list(range(120))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(500, 500 + i) for i in range(40)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def boilerplate_model(rows, min_sites):
    sites, home = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            k = line.strip(" ")
            if k:
                sites.setdefault(k, set()).add(site or "")
                home.setdefault(k, []).append(i)
    gone = {k: min((h for h in home[k] if h is not None), default=None) for k, s in sites.items() if len(s) >= min_sites}
    return [(i, None if text is None else "\n".join(x for x in text.split("\n") if gone.get(x.strip(" "), i) == i)) for i, text, _ in rows]


def test_op4(spark, odd, clashing, nothing, documents):
    for df, n in ((odd, 2), (clashing, 2), (documents, 3), (documents, 10), (documents, 1)):
        found = line_dedup.remove_boilerplate(df, min_sites=n)
        expected = boilerplate_model([(r.doc_id, r.text, r.source) for r in df.collect()], n)
        assert sorted(map(str, found.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(expected, "doc_id long, text string").collect()))
    assert line_dedup.remove_boilerplate(nothing).count() == 0


def test_op4_sketches(spark):
    """Spreads on both sides of a large threshold, where the sketches only estimate."""
    rows = [(f"line {n}", s) for n in (900, 960, 999, 1000, 1001, 1040, 1200) for s in range(n)]
    df = spark.createDataFrame(rows, "line string, s long").select(*line_dedup.line_key(F.col("line")), F.col("s").alias("site"), F.col("s").alias("doc_id"), "line")
    keys = {tuple(r[:2]): r[2] for r in df.select("h", "g", "line").distinct().collect()}
    found = {keys[r.h, r.g] for r in line_dedup.boilerplate(df.drop("line"), 1000).collect()}
    assert found == {"line 1000", "line 1001", "line 1040", "line 1200"}


def test_op4_query(spark, sf, duck):
    found = line_dedup.op4_line_dedup(spark, sf)
    expected = duck.sql(line_dedup.OP4_SQL)
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())


def spark_hash(*values):
    """xxhash64 of strings, longs (int) and ints (np.int32), as a signed number."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def omh_model(text, k=order_minhash.K, rings=order_minhash.RINGS, places=order_minhash.PLACES):
    """The definition, item by item: the two items that every place selects, in text order."""
    short = lambda h: h >> order_minhash.POSITION_BITS
    hashed = [spark_hash(w) for w in words_of(text)]
    kmers = [short(spark_hash(*hashed[i : i + k])) for i in range(len(hashed))] or [short(spark_hash(""))]
    seen, items = {}, []
    for x in kmers:
        seen[x] = n = seen.get(x, -1) + 1
        items.append(short(spark_hash(x, np.int32(n))) if n else x)
    out = []
    for ring in range(rings):
        turned = [(short(spark_hash(x, np.int32(ring))), at) for at, x in enumerate(items)]
        for j in range(places):
            place = short(-(1 << 63) + j * ((1 << 64) // places))
            first = sorted(turned, key=lambda t: (t[0] < place, t))
            a, b = sorted((first[0], first[1 % len(first)]), key=lambda t: t[1])
            out.append(spark_hash(a[0], b[0]) & 0x7FFFFFFF)
    return out


def test_op5(spark, odd, clashing, nothing, documents):
    """Every row of the result against a model of the editing and of the fingerprints, repeated rows included."""
    for df, limit in ((documents, 60), (clashing, 60), (odd, 60)):
        rows = [((-(1 << 63)) if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()]
        order = sorted(set(rows), key=lambda r: (r[0], spark_hash(r[1])))
        expected, models = [], {}
        for i, (key, text) in enumerate(order):
            following = order[(i + 1) % len(order)]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[1][:half]
            for t in (text, edited, following[1]):
                if i < limit and t not in models and len(t) < 20_000:
                    models[t] = omh_model(t)
            expected += [(None if key == -(1 << 63) else key, text, edited, following[1])] * rows.count((key, text))
        found = order_minhash.edited_fingerprints(df).collect()
        assert len(found) == len(rows)
        left = sorted(((str(r.doc_id), r.n_chars, r.edited_sha256), r.fp, r.edited_fp, r.next_fp) for r in found)
        right = sorted(((str(k), len(t), hashlib.sha256(e.encode()).hexdigest()), t, e, n) for k, t, e, n in expected)
        for (name, fp, edited_fp, next_fp), (model, *texts) in zip(left, right, strict=True):
            assert name == model
            for got, text in zip((fp, edited_fp, next_fp), texts, strict=True):
                assert text not in models or got == models[text], text[:80]
    assert order_minhash.edited_fingerprints(nothing).count() == 0
    lone = order_minhash.edited_fingerprints(odd.where("doc_id = 1")).first()
    assert lone.fp == lone.next_fp


def test_op5_ties(spark):
    df = spark.createDataFrame([(1, "b c"), (1, "a b"), *[(2, "x y")] * 300], "doc_id long, text string")
    found = order_minhash.edited_fingerprints(df).collect()
    assert sorted(r.doc_id for r in found) == [1, 1] + [2] * 300


def test_op5_repeated_kmers(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices("abc", k=n)) for n in [*range(8), 30, 200]] + ["a " * 500, "a b " * 90 + "c", "\u3000x \x1cy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.fp for r in order_minhash.fingerprints(df).collect()} == {i: omh_model(t) for i, t in enumerate(texts)}


def likeness(a, b):
    return sum(p == q for p, q in zip(a, b, strict=True)) / len(a)


def test_op5_has_no_border_of_lengths(spark):
    """A text without its last words stays like itself at every length, around 20 words as elsewhere."""
    rng = random.Random(12)
    means = {}
    for n in (8, 12, 16, 19, 20, 21, 22, 24, 40, 80, 400):
        texts = [[f"w{rng.randrange(9000)}" for _ in range(n)] for _ in range(40)]
        df = spark.createDataFrame([(f"{i} {part}", " ".join(w[: n - cut])) for i, w in enumerate(texts) for part, cut in (("whole", 0), ("less one", 1), ("less three", 3))], "doc_id string, text string")
        fp = {r.doc_id: r.fp for r in order_minhash.fingerprints(df).collect()}
        means[n] = [np.mean([likeness(fp[f"{i} whole"], fp[f"{i} {part}"]) for i in range(40)]) for part in ("less one", "less three")]
    for low, high in zip([*means][:-1], [*means][1:], strict=True):
        assert means[high][0] > means[low][0] - 0.08 and means[high][1] > means[low][1] - 0.08, means
    assert means[19][1] > 0.25 and means[22][1] > 0.3 and means[22][0] > 0.55


def test_op5_estimates_as_independent_orders_do(spark):
    """The mean and the spread of the likeness at a given change, against a hash order for every component."""
    rng = np.random.default_rng(5)
    for n in (60, 400):
        texts, pairs = [], 120
        for _ in range(pairs):
            a = [f"w{x}" for x in rng.integers(0, 90_000, n)]
            b = list(a)
            for at in rng.choice(n, n // 20, replace=False):
                b[at] = f"v{rng.integers(0, 90_000)}"
            texts += [a, b]
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        fp = {r.doc_id: r.fp for r in order_minhash.fingerprints(df).collect()}
        own = np.array([likeness(fp[2 * i], fp[2 * i + 1]) for i in range(pairs)])
        ideal = []
        for i in range(pairs):
            a, b = ([tuple(t[j : j + order_minhash.K]) for j in range(n)] for t in texts[2 * i : 2 * i + 2])
            every = sorted({*a, *b})
            order = np.argsort(rng.random((len(fp[0]), len(every))), axis=1)
            at_a, at_b = ({x: j for j, x in enumerate(t)} for t in (a, b))
            same = 0
            for o in order:
                two = lambda at: sorted([every[x] for x in o if every[x] in at][:2], key=at.get)  # noqa: E731, B023
                same += two(at_a) == two(at_b)
            ideal.append(same / len(order))
        assert abs(own.mean() - np.mean(ideal)) < 0.04 and own.std() < 1.5 * np.std(ideal), (n, own.mean(), np.mean(ideal), own.std(), np.std(ideal))


def test_op5_is_order_sensitive(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    a = [rng.choice(vocabulary) for _ in range(400)]
    swapped = a[200:] + a[:200]
    changed = a[:390] + [rng.choice(vocabulary) for _ in range(10)]
    other = [rng.choice(vocabulary) for _ in range(400)]
    texts = {"a": a, "same": a, "swapped": swapped, "changed": changed, "other": other, "twice": a + a}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id string, text string")
    fp = {r.doc_id: r.fp for r in order_minhash.fingerprints(df).collect()}
    like = lambda x, y: likeness(fp[x], fp[y])
    assert like("a", "same") == 1.0 and like("a", "other") == 0.0
    assert like("a", "changed") > 0.8
    assert 0.2 < like("a", "swapped") < 0.8  # all k-mers but a few are shared, their order isn't
    assert like("a", "twice") < 0.6  # as many distinct k-mers, other occurrences


def test_op5_query(spark, sf):
    found = order_minhash.op5_order_minhash(spark, sf).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 512 for r in found)
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.9
