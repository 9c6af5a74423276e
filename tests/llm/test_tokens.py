"""Operators 1, 7 and 10 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from compare import rows_of
from tokenizers import Tokenizer

from rillstone.llm import packing, token_counts, tokenization
from rillstone.llm.bpe_automaton import BpeAutomaton, WordBpeCodec, byte_alphabet, codec

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts(library, texts):
    bpe = codec(PATH)
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, repr(text)
        assert bpe.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_random_words(library):
    rng = np.random.default_rng(5)
    syllables = ["th", "e", "ing", "qu", "aa", "a", "zz", "tion", "ee", "é", "ss", "'", "!", "!!", "9"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 12))) for _ in range(3000)] + ["a" * n for n in range(1, 70)] + ["!" * n for n in range(1, 70)]
    text = " ".join(words)
    assert codec(PATH).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_is_the_merge_rule():
    """All words up to six letters over a small merge list, against merging by hand."""
    names = byte_alphabet()
    vocab = {c + s: i for i, (s, c) in enumerate(product(("", "</w>"), names))}
    merges = []
    for a, b in [("a", "a"), ("a", "b"), ("b", "a"), ("aa", "b"), ("ab", "ab"), ("a", "b</w>"), ("ab", "a</w>"), ("aa", "aa"), ("b", "ab</w>")]:
        merges.append((a, b))
        vocab[a + b] = len(vocab)
    machine = BpeAutomaton(vocab, merges)
    ranks = {m: i for i, m in enumerate(merges)}
    words = ["".join(w) for n in range(1, 8) for w in product("ab", repeat=n)]
    ids, ends = machine.encode_words(words)
    for word, lo, hi in zip(words, [0, *ends], ends, strict=False):
        parts = [*word[:-1], word[-1] + "</w>"]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [machine.labels[t] for t in ids[lo:hi]] == parts, word


def small_automaton(rng, n):
    """A random merge list over a few letters: (machine, merges)."""
    names = byte_alphabet()
    vocab = {c + s: i for i, (s, c) in enumerate(product(("", "</w>"), names))}
    tokens, merges = ["a", "b", "c", "a</w>", "b</w>"], []
    while len(merges) < n:
        u, v = (t for t in rng.sample(tokens, 2))
        if rng.random() < 0.2:
            v = u
        if not u.endswith("</w>") and u + v not in vocab and len(u + v) < 24:
            merges.append((u, v))
            vocab[u + v] = len(vocab)
            tokens.append(u + v)
    return BpeAutomaton(vocab, merges), merges, vocab


def test_arcs_are_those_of_the_gadget_construction():
    """has_arc for every state and token against an automaton whose states and arcs are spelled out."""
    rng = random.Random(4)
    for _ in range(12):
        machine, merges, vocab = small_automaton(rng, 14)
        states = [{vocab[c + s]: 0 for c in "abc" for s in ("", "</w>")}]
        for a, b in merges:
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            q = next((arcs[u] for arcs in states if u in arcs), None)
            if q is None or v not in states[q]:
                continue
            into = states[q][v]
            states.append({t: s for t, s in states[q].items() if t != v})
            for arcs in states:
                if u in arcs:
                    arcs[u] = len(states) - 1
                    arcs[uv] = into
        tokens = sorted({t for arcs in states for t in arcs})
        entered = {t: arcs[t] for arcs in states for t in arcs}
        pairs = [(s, t) for s in tokens for t in tokens if not machine.labels[s].endswith("</w>")]
        found = machine.has_arc(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        assert found.tolist() == [t in states[entered[s]] for s, t in pairs]


def test_every_script_takes_the_automaton(library, monkeypatch):
    """Greek, Cyrillic, Chinese, Korean, Thai, combining marks, ligatures, emoji, odd blanks, special strings."""
    bpe = WordBpeCodec(PATH)
    monkeypatch.setattr(bpe.automaton, "encode_words", lambda words, f=bpe.automaton.encode_words: (seen.extend(words), f(words))[1])
    rng = random.Random(8)
    parts = "Привет ΣΊΣΥΦΟΣ 中文字符 한국어 ภาษาไทย e\u0301 n\u0303o \ufb01n \U0001f600\U0001f3fd it's IT'S ½ ٣ 二 İstanbul ǅ ẞ <|endoftext|> <|startoftext|> <|end a\u2028b \xa0 \x1c \x85 \u200b \ufeff Don't 'LL x'll".split(" ")
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\u3000"]) for _ in range(30)) for _ in range(200)]
    for text in texts:
        seen: list[str] = []
        assert bpe.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert not hasattr(bpe, "library") and {"привет", "中文字符", "\u0301" if "\u0301" in bpe.words else "é"} & set(bpe.words)


def test_plain_characters(library):
    """Every character that texts split here may hold, in words, beside blanks and doubled; some have their lower case beyond Latin."""
    bpe = WordBpeCodec(PATH)
    plain = [c for c in map(chr, range(0x2100)) if bpe.PLAIN.fullmatch(c) and not c.isspace()]
    texts = [t for c in plain for t in (c, f"a{c}b, {c}x1{c}{c}.", f"\n{c}'s{c}{c}a'll9{c} \t{c}")]
    for text, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_chunk_is_cut_once(monkeypatch, library):
    """Python code takes the distinct stretches of a chunk together, not one by one."""
    bpe = WordBpeCodec(PATH)
    calls = []
    monkeypatch.setattr(bpe, "split", lambda text, f=bpe.split: (calls.append(text), f(text))[1])
    texts = [" ".join(f"word{i}, it's" for i in range(k, k + 50)) for k in range(0, 400, 10)] + ["", " \n", "Привет, it's"]
    assert [x.tolist() for x in bpe.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(calls) == 1 and calls[0].count("it's") == 1


def test_cache_may_overflow(monkeypatch, library):
    monkeypatch.setattr("rillstone.llm.bpe_automaton.CACHE_WORDS", 3)
    monkeypatch.setattr("rillstone.llm.bpe_automaton.CACHE_STRETCHES", 3)
    bpe = WordBpeCodec(PATH)
    for text in ("one two three four five", "five six", "seven one two", "a b c d e f g"):
        assert bpe.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def check_codec(rows, source, library):
    expected = []
    for r in source:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


def test_op10(odd, clashing, nothing, library, documents):
    for df in (odd, clashing, documents):
        check_codec(tokenization.encode_documents(df, PATH, decode=True, as_text=True).collect(), df.collect(), library)
    assert tokenization.encode_documents(nothing, PATH).count() == 0
    arrays = tokenization.encode_documents(odd, PATH)
    back = {(r.doc_id, r.decoded) for r in tokenization.decode_documents(arrays, PATH).collect()}
    assert back == {(r.doc_id, r.decoded) for r in tokenization.encode_documents(odd, PATH, decode=True).collect()}


def test_op10_query(spark, sf, library, documents):
    found = {r.doc_id: r for r in tokenization.op10_bpe_codec(spark, sf).collect()}
    for r in documents.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(pieces, expected):
    """``expected``: (key, ids) of every row, keys repeating with equal ids."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_key[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    copies = defaultdict(list)
    for key, ids in expected:
        copies[key].append(ids)
    assert set(by_key) == set(copies)
    for key, lists in copies.items():
        n = len(lists)
        ids = lists[0]
        own = sorted(by_key[key], key=lambda p: p.start)
        assert [p.start for p in own[::n]] == [sum(q.length for q in own[:i:n]) for i in range(0, len(own), n)]
        for p in own:
            assert p.doc_tokens == len(ids)
            assert bytes(p.tokens) == np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
        assert sum(p.length for p in own) == n * len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(p.length for p in pieces), len(by_sequence)


def test_op1(odd, clashing, nothing, library, documents):
    for df in (odd, clashing, documents):
        rows = df.collect()
        expected = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in rows]
        tokens, sequences = check_packing(packing.pack_documents(df.coalesce(1), PATH).collect(), expected)
        assert tokens > 0.9 * 4096 * (sequences - 1)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_op1_query(spark, sf, library, documents):
    found = packing.op1_harmonic_packing(spark, sf).collect()
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in documents.collect()}
    for p in found:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in found) == sum(map(len, ids.values()))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_bins(capacity):
    """Whole documents, fixed counts, few cuts, no short piece but short documents, little padding."""
    rng = random.Random(capacity)
    lengths = [1, 2, 31, 32, 33, capacity - 1, capacity, capacity + 1, 3 * capacity + 5] + [int(rng.paretovariate(0.8) * capacity / 60) + 1 for _ in range(4000)] + [1] * 100
    rng.shuffle(lengths)
    packer = packing.HarmonicPacker(capacity)
    placed = [p for d, n in enumerate(lengths) for p in packer.add(d, n)]
    placed += packer.finish()
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in placed:
        pieces[p.document].append((p.start, p.length))
        bins[p.sequence].append((p.offset, p.length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length >= min(packing.LEAST, n)
            at += length
        assert at == n
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(packer.next))
    if capacity == 4096:
        assert len(placed) < 1.3 * (len(lengths) + sum(n // capacity for n in lengths)) and sum(lengths) > 0.99 * capacity * (packer.next - 1)


def test_a_bin_takes_a_fixed_count():
    packer = packing.HarmonicPacker()
    placed = [p for d, n in enumerate([1365, 1300, 1365]) for p in packer.add(d, n)]
    assert [(p.document, p.offset) for p in placed] == [(0, 0), (1, 1365), (2, 2665)]
    assert packer.add(3, 2000) == [packing.Placed(0, 4030, 3, 0, 66)]  # the gap is filled by what comes next
    assert packer.finish() == [packing.Placed(1, 0, 3, 66, 1934)]


def test_op7(spark, odd, clashing, nothing, documents, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    cache = f"file://{tmp_path}/cache"
    for df in (odd, clashing, documents, nothing):  # the second run finds all of its counts
        found = token_counts.count_tokens(df, path, cache)
        expected = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
        assert rows_of(found.columns, found.collect()) == rows_of(["doc_id", "n_bytes", "n_tokens"], expected)
    stored = spark.read.parquet(f"{cache}/tokenizer={token_counts.tokenizer_digest(path)}")
    distinct = {r.text or "" for df in (odd, documents) for r in df.collect()}
    assert stored.count() == stored.select("digest").distinct().count() == len(distinct)


def test_op7_trusts_the_cache(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache, digest = f"file://{tmp_path}/cache", bytearray(hashlib.sha256(b"one").digest())
    own = f"{cache}/tokenizer={token_counts.tokenizer_digest(path)}"
    spark.createDataFrame([(digest, 77), (digest, 77)], token_counts.CACHE_SCHEMA).write.parquet(own)
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd.where("doc_id in (1, 5)"), path, cache).collect()}
    assert found[5] == 77 and found[1] < 77
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(odd.where("doc_id = 5"), piece, cache).first().n_tokens < 5


def test_op7_query(spark, sf, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in token_counts.op7_token_counts(spark, sf).collect()}
    for r in documents.collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (found[r.doc_id].n_tokens, found[r.doc_id].n_bytes, found[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 1024)
