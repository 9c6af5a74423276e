"""BPE encoding and decoding by a tokenization automaton (operator 10).

**Construction.** Start with one state that has a self-loop for every base symbol: it accepts any
sequence of symbols. Then apply the merges in order; merge ``(u, v) -> uv`` of rank ``r`` inserts a
gadget: with ``q`` the state after ``u``,

* ``q'`` is a copy of ``q`` without its ``v`` arc,
* every ``u`` arc now enters ``q'``,
* every state that has a ``u`` arc gets a ``uv`` arc to the state that ``v`` led to from ``q``.

After the last merge the automaton is deterministic, and it accepts exactly the token sequences
that BPE makes. (M. Berglund, W. Martens, B. van der Merwe: "Constructing a BPE tokenization DFA".)

**Representation.** All ``u`` arcs enter the same state, so a state is named by the token that
enters it, and copies share structure: ``q'`` is its parent ``q`` plus one removed arc. What a
state has removed is thus the list of (arc, rank) along its parents, which are the states of the
token's right children as they were when the token was made. An arc ``t`` leaves a state unless an
arc of ``t``'s left children had been removed before the gadget of its parent would have added the
longer arc. Both lists are compiled into fixed tables of *spines* and *birth ranks*, and removals
into one hash table (token, arc) -> rank, so that a transition test is a few table look-ups.

**Encoding.** Every prefix of a word has one accepted path, hence for every position one token ends
there. Distinct words are encoded together: a trie finds the tokens that start at each position, and
for positions from left to right the transition table keeps the arcs that leave the state reached
so far. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

END_OF_WORD = "</w>"
NEVER = np.int32(2**31 - 1)

#: Words kept in a worker's memory; a full store is emptied, which costs time and changes no result.
CACHE_WORDS = 400_000

#: Stretches between blanks that are cut into words together; bounds the lists in use.
CACHE_STRETCHES = 250_000

#: Words whose paths are followed together; bounds the arrays in use.
WORDS_AT_ONCE = 25_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class HashTable:
    """Open addressing from non-negative int64 keys to int32, looked up by whole arrays.

    A table of marks, small enough for a processor's cache, tells most absent keys.
    """

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
    MARK_BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        self.marks = np.zeros(1 << self.MARK_BITS, bool)
        mixed = self._mixed(keys)
        self.marks[self._mark(mixed)] = True
        slot, left = (mixed >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + (self.keys[slot[left]] != keys[left])) & self.mask

    def _mixed(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * self.MULTIPLIER

    def _mark(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.MARK_BITS)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, value): the places in ``keys`` of those that the table holds, ascending, and their values."""
        mixed = self._mixed(keys)
        at = np.flatnonzero(self.marks[self._mark(mixed)])
        wanted, slot = keys[at], (mixed[at] >> self.shift).view(np.int64)
        found = self.keys[slot]
        left = np.flatnonzero((found != wanted) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found[left] = now = self.keys[slot[left]]
            left = left[(now != wanted[left]) & (now != -1)]
        hit = found == wanted
        return at[hit], self.values[slot[hit]]


class BpeAutomaton:
    """The compiled automaton of one merge list.

    ``vocab`` maps token strings to ids, ``merges`` lists pairs in order of priority. With ``suffix``,
    the last symbol of a word is the byte's stand-in followed by it.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = END_OF_WORD):
        names = byte_alphabet()
        self.n = max(vocab.values()) + 1
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.final = np.array([vocab[c + suffix] for c in names], np.int32)
        self.labels: list[str] = [""] * self.n
        for name, i in vocab.items():
            self.labels[i] = name
        left, right = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        born = np.zeros(self.n, np.int32)
        symbols: list[tuple[int, ...]] = [()] * self.n
        for i in {*self.inner.tolist(), *self.final.tolist()}:
            symbols[i] = (i,)
        removed: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            if symbols[uv]:
                raise ValueError(f"two merges make {a + b!r}; the gadget of each needs a token of its own")
            removed[u << 20 | v] = rank  # the state after u loses v; its parent is what it was before
            left[uv], right[uv], born[uv], symbols[uv] = u, v, rank, symbols[u] + symbols[v]
        self.length = np.array([len(s) for s in symbols], np.int32)
        self.removed = HashTable(np.fromiter(removed, np.int64, len(removed)), np.fromiter(removed.values(), np.int32, len(removed)))
        self.after, self.after_until = self._spine(right, born)
        self.arcs, self.arcs_until = self._spine(left, born)
        self._trie(symbols)

    def _spine(self, child: np.ndarray, born: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Level k: each token's k-th descendant (or -1), and the rank at which it was absorbed."""
        tokens, until = [np.arange(self.n, dtype=np.int32)], [np.full(self.n, NEVER, np.int32)]
        while True:
            last = tokens[-1]
            down = np.where(last >= 0, child[last], -1)
            if (down < 0).all():
                return tokens, until
            tokens.append(down.astype(np.int32))
            until.append(np.where(last >= 0, born[last], 0).astype(np.int32))

    def _trie(self, symbols: list[tuple[int, ...]]) -> None:
        nodes: dict[int, int] = {}
        token_at = [-1]
        for i, sequence in enumerate(symbols):
            node = 0
            for s in sequence:
                node = nodes.setdefault(node << 20 | s, len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            if sequence:
                token_at[node] = i
        self.token_at = np.array(token_at, np.int32)
        self.trie = HashTable(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        # The first two symbols, numbered among the base symbols, lead to their node in one look-up.
        base = sorted({*self.inner.tolist(), *self.final.tolist()})
        self.base_number = np.zeros(self.n, np.int32)
        self.base_number[base] = np.arange(len(base))
        self.one = np.array([nodes[s] for s in base], np.int32)
        first = {int(node): number for number, node in enumerate(self.one)}
        self.two = np.full((len(base), len(base)), -1, np.int32)
        for key, node in nodes.items():
            parent = key >> 20
            if parent in first:
                self.two[first[parent], self.base_number[key & 0xFFFFF]] = node

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state entered by ``state`` has an arc ``token`` (arrays of ids)."""
        ok = np.ones(len(state), bool)
        rows, w = np.arange(len(state)), state
        for after_until, next_after in zip(self.after_until, [*self.after[1:], None], strict=True):
            w_until = after_until[state[rows]]
            some, v, t = rows, w, token[rows]
            u = t
            for k, arcs_until in enumerate(self.arcs_until):
                if k:
                    u = self.arcs[k][t]
                    keep = np.flatnonzero(u >= 0)
                    if not len(keep):
                        break
                    some, v, w_until, t, u = some[keep], v[keep], w_until[keep], t[keep], u[keep]
                at, rank = self.removed.find(v.astype(np.int64) << 20 | u)
                lost = at[(rank < w_until[at]) & (rank <= arcs_until[t[at]])]
                ok[some[lost]] = False
            if next_after is None:
                break
            w = next_after[state[rows]]
            keep = np.flatnonzero((w >= 0) & ok[rows])
            if not len(keep):
                break
            rows, w = rows[keep], w[keep]
        return ok

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids end."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        flat = np.frombuffer(b"".join(raw), np.uint8)
        filled = sizes > 0
        symbols = self.inner[flat]
        symbols[ends[filled] - 1] = self.final[flat[ends[filled] - 1]]
        n = len(flat)
        narrow = np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int64
        place = (np.arange(n) - np.repeat(starts, sizes)).astype(narrow)
        room = np.repeat(ends, sizes) - np.arange(n)
        number = self.base_number[symbols]
        found = [(np.arange(n), self.token_at[self.one[number]])]  # every token that starts at every position
        at = np.flatnonzero(room > 1)
        node = self.two[number[at], number[at + 1]]
        keep = np.flatnonzero(node >= 0)
        at, node = at[keep], node[keep].astype(np.int64)
        depth = 2
        while len(at):
            token = self.token_at[node]
            is_token = np.flatnonzero(token >= 0)
            found.append((at[is_token], token[is_token]))
            keep = np.flatnonzero(room[at] > depth)
            at, node = at[keep], node[keep]
            where, node = self.trie.find(node << 20 | symbols[at + depth])
            at, node = at[where], node.astype(np.int64)
            depth += 1
        at, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place[at], kind="stable")
        at, token = at[order], token[order]
        ending = np.full(n, -1, np.int32)  # the token that ends at each position on its prefix's path
        bounds = np.searchsorted(place[at], np.arange(int(sizes.max(initial=0)) + 1))
        for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            i, t = at[a:b], token[a:b]
            if p:
                ok = self.has_arc(ending[i - 1], t)
                i, t = i[ok], t[ok]
            ending[i + self.length[t] - 1] = t
        which, at, steps = np.flatnonzero(filled), ends[filled] - 1, []
        while len(which):
            t = ending[at]
            steps.append((which, t))
            at = at - self.length[t]
            keep = at >= starts[which]
            which, at = which[keep], at[keep]
        counts = np.zeros(len(raw), np.int64)
        for w, _ in steps:
            counts[w] += 1
        bound = np.cumsum(counts)
        ids, fill = np.zeros(int(bound[-1]) if len(bound) else 0, np.int32), bound.copy()
        for w, t in steps:
            fill[w] -= 1
            ids[fill[w]] = t
        return ids, bound


def joined(strings: pa.Array, between: str) -> str:
    """The strings of an array of large strings as one."""
    return pa.compute.binary_join(pa.LargeListArray.from_arrays([0, len(strings)], strings), pa.scalar(between, strings.type))[0].as_py()


def gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` is a row of runs of these ``sizes``: the runs that ``which`` numbers, in a row, and where each ends."""
    count = sizes[which]
    ends = np.cumsum(count)
    shift = (np.cumsum(sizes) - sizes)[which] - ends + count
    return values[np.arange(count.sum()) + np.repeat(shift, count)], ends


def _letters(kind: str) -> str:
    """A pattern's set of the Latin characters of a kind and of their lower case, which may lie beyond them."""
    found = [c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind]
    return "".join(map(re.escape, sorted({*found, *(c.lower() for c in found if len(c.lower()) == 1)})))


class WordBpeCodec:
    """Encodes and decodes whole texts with a lower-casing word-level tokenizer file.

    All words take the automaton. Texts of Latin letters, where lower case and character classes are
    beyond doubt, are split here; the tokenizers library's own normalizer and pattern, as the file
    names them, split a text that has any other character.
    """

    PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ɏ‐-‧€]*")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.pattern = path, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.automaton = BpeAutomaton(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])
        if max((t["id"] for t in spec["added_tokens"]), default=0) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens are found as they are written")
        self.special = {t["content"]: np.uint16(t["id"]).tobytes() for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        if not all("<|" in s for s in self.special):
            raise ValueError("special tokens are told by <|")
        self.labels = list(self.automaton.labels)
        for t in spec["added_tokens"]:
            self.labels += [""] * (t["id"] + 1 - len(self.labels))
            self.labels[t["id"]] = t["content"]
        self.decimals = list(map(str, range(len(self.labels))))
        letter, number = _letters("L"), _letters("N")
        # The file's pattern, and a space; the alternatives that start with a letter, the usual ones, come first.
        self.split = re.compile(rf"[{letter}]+| |[{number}]|'(?:s|t|re|ve|m|ll|d)|[^\s{letter}{number}]+").findall
        self.words: dict[str, bytes] = {}

    def is_plain(self, text: str) -> bool:
        return self.PLAIN.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in self.special))

    @property
    def splitter(self):
        if not hasattr(self, "_splitter"):
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            normalize = Tokenizer.from_file(self.path).normalizer.normalize_str
            split = pre_tokenizers.Split(Regex(self.pattern), behavior="removed", invert=True).pre_tokenize_str
            self._splitter = lambda text: [w for w, _ in split(normalize(text))]
        return self._splitter

    def _learn(self, words: list[str]) -> list[bytes]:
        """Follow these words through the automaton and have their ids in store."""
        out: list[bytes] = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            ids, bound = self.automaton.encode_words(words[i : i + WORDS_AT_ONCE])
            raw, end = ids.astype(np.uint16).tobytes(), (2 * bound).tolist()
            out += [raw[a:b] for a, b in zip([0, *end], end, strict=False)]
        self.words.update(zip(words, out, strict=True))
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words, from the store as far as it has them."""
        found = list(map(self.words.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
            return self._learn(words)
        learned = iter(self._learn(missing))
        return [next(learned) if ids is None else ids for ids in found]

    def _cut(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these stretches in a row, and how many each has."""
        # The pattern finds the space before each stretch as a word of its own, which comes first and so has number 0.
        coded = pa.array(self.split(" " + joined(stretches, " ")), pa.large_string()).dictionary_encode()
        known = self._known(joined(coded.dictionary[1:], "\n").split("\n") if len(coded.dictionary) > 1 else [])
        word, size = coded.indices.to_numpy(), np.fromiter(map(len, known), np.int64, len(known)) // 2
        at = np.flatnonzero(word == 0)
        ids, ends = gathered(np.frombuffer(b"".join(known), np.uint16), size, word[word > 0] - 1)
        return ids, np.diff(np.concatenate([[0], ends])[np.append(at, len(word)) - np.arange(len(at) + 1)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without added special tokens."""
        where = [i for i, t in enumerate(texts) if self.is_plain(t)]
        # Arrow tells stretches and words apart, so that Python code sees each once.
        stretches = pa.compute.ascii_split_whitespace(pa.array([texts[i].lower() for i in where], pa.large_string()))
        coded = stretches.flatten().dictionary_encode()
        parts = [self._cut(coded.dictionary[i : i + CACHE_STRETCHES]) for i in range(0, len(coded.dictionary), CACHE_STRETCHES)]
        ids, size = (np.concatenate(x) for x in zip((np.zeros(0, np.uint16), np.zeros(0, np.int64)), *parts, strict=True))
        ids, ends = gathered(ids, size, coded.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[stretches.offsets.to_numpy()].tolist()
        out = {i: ids[a:b] for i, a, b in zip(where, bounds, bounds[1:], strict=False)}
        others = {i: [p if k % 2 else self.splitter(p) for k, p in enumerate(self.at_special(t))] for i, t in enumerate(texts) if i not in out}
        words = list(set().union(*(p for parts in others.values() for p in parts[::2])))
        get = dict(zip(words, self._known(words), strict=True)).__getitem__
        for i, parts in others.items():
            raw = b"".join(self.special[p] if k % 2 else b"".join(map(get, p)) for k, p in enumerate(parts))
            out[i] = np.frombuffer(raw, np.uint16)
        del stretches, coded
        pa.default_memory_pool().release_unused()  # else it keeps what its largest chunk took
        return [out[i] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        """The arcs' labels, joined by a space as the file, which names no decoder, has it."""
        return " ".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> WordBpeCodec:
    """One codec for each worker process and file."""
    return WordBpeCodec(path)
