"""The near-dedup of the pipeline against all pairs' similarities."""

import importlib
import random

from test_duplicates import words_of

from rillstone.llm import near_texts, simhash


def shingles(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def kept_model(rows):
    """Least key of each component of similarity 0.8 and more."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if parent[i] == i}


def edited(rng, words, share):
    at = set(rng.sample(range(len(words)), max(1, int(share * len(words)))))
    return [f"e{rng.random()}" if i in at else w for i, w in enumerate(words)]


def test_near_dedup_keeps_one_of_each_group(spark, nothing, documents):
    """Copies at similarities around 0.8, chains of copies of copies, and short texts."""
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(5)
    texts = ["", " \t", "one", "One", "a b c d e", "a b c d e f"]
    for _ in range(30):
        last = base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(40, 300))]
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.03):
            texts.append(" ".join(edited(rng, base, share)))
            last = edited(rng, last, share / 2)
            texts.append(" ".join(last))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], nothing.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert {r.doc_id for r in pipeline.near_dedup(spark, df, "").collect()} == kept_model(rows)
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    assert {r.doc_id for r in simhash.survivors(documents, find=near_texts.near_texts).collect()} == kept_model(rows)


def crowd(rng, n, shared):
    """Copies of one text with a few edits each, of which ``shared`` say how often an edit is another copy's."""
    base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 160))]
    edits, out = [], []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            if not edits or rng.random() > shared:
                edits.append((rng.randrange(len(base)), rng.choice("rid"), f"e{rng.random()}", rng.randrange(1, 25)))
            at, kind, new, size = rng.choice(edits) if rng.random() < shared else edits[-1]
            words[at : at + {"r": 1, "i": 0, "d": size}[kind]] = [] if kind == "d" else [new]
        out.append(" ".join(words))
    return out


def test_crowds_of_copies(spark):
    """Groups of over ``CROWD`` near copies, many of them around similarity 0.8, against all pairs."""
    for seed, shared in enumerate((0, 0.3, 0.8)):
        rng = random.Random(seed)
        rows = list(enumerate(t for _ in range(3) for t in crowd(rng, 90, shared)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        found = near_texts.near_texts(df).collect()
        assert {r.component_id for r in found} == kept_model(rows), shared


def test_crowds_make_few_pairs(spark, monkeypatch):
    """Copies whose edits are their own and that are not alike each other make no pairs to compare."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(len(base)), 1 + k % 4):
            words[at] = f"e{rng.random()}"
        texts.append(" ".join(words))
    made = {}

    def noted(df, label, write=near_texts.materialize):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(near_texts, "materialize", noted)
    near_texts.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert made["pairs"].count() < 0.1 * 300 * 299 / 2


def test_near_dedup_meets_the_pairs_of_fingerprints(spark, monkeypatch):
    """The stage's pairs have those of op8's tiles among them."""
    pipeline = importlib.import_module("corpus_pipeline")
    rng, seen = random.Random(8), []
    base = [f"w{rng.randrange(900)}" for _ in range(600)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{rng.randrange(900)}" for _ in range(300))]
    df = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")

    def noted(rows, found=near_texts._by_fingerprints):
        seen.append(found(rows).count())
        return found(rows)

    monkeypatch.setattr(near_texts, "_by_fingerprints", noted)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, df, "").collect()) == [0, 2]
    assert seen == [1]
