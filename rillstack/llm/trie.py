"""BPE of many words at once by walking their trie depth first.

For every byte prefix of a word, BPE's last token is fixed: it is the one vocabulary entry t that
ends there for which BPE leaves (last token of the prefix without t, t) apart. So a node of the
trie holds one token, found from the nodes above it, and words that share a prefix share its
states. Sorted words, taken one after another, visit the trie depth first; the stack is the path.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillstack.llm.bpe import SPECIAL, Encoder, ranks, sorts_of, tokenizer
from rillstack.llm.common import tokenizer_path

#: Pairs of tokens whose answer a worker keeps.
MAX_PAIRS = 1_000_000

_L = "A-Za-zÀ-ÖØ-öø-ɿ"
_S = "\\t-\\r "
#: The vocabulary's split pattern for ASCII and U+00C0 to U+027F.
PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Vocabulary:
    """A rank table, with an automaton that knows the longest token that ends at each byte."""

    def __init__(self, table: dict[bytes, int]):
        self.table = table
        self.bytes = {i: b for b, i in table.items()}
        self.length = [0] * (max(self.bytes) + 1)
        for i, b in self.bytes.items():
            self.length[i] = len(b)
        self.apart: dict[tuple[int, int], bool] = {}
        self.build()

    def build(self) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for word, t in self.table.items():
            s = 0
            for c in word:
                key = s << 8 | c
                n = child.get(key)
                if n is None:
                    n = child[key] = len(token)
                    token.append(-1)
                s = n
            token[s] = t
        fail = [0] * len(token)
        shorter = [-1] * len(self.length)  # the longest token that is a proper suffix of a token
        longest = [-1] * len(token)  # the longest token that is a suffix of a state's bytes
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for key, n in child.items():
            by_parent.setdefault(key >> 8, []).append((key & 255, n))
        line = [0]
        for s in line:
            for c, n in by_parent.get(s, ()):
                f = fail[s]
                while s and f and (f << 8 | c) not in child:
                    f = fail[f]
                fail[n] = child.get(f << 8 | c, 0) if s else 0
                below = longest[fail[n]]
                if token[n] >= 0:
                    shorter[token[n]] = below
                    longest[n] = token[n]
                else:
                    longest[n] = below
                line.append(n)
        self.fail, self.longest, self.shorter, self.goto = fail, longest, shorter, child
        self.steps: dict[int, int] = {}

    def step(self, s: int, c: int) -> int:
        """The automaton's state after byte c; found once for each state and byte."""
        goto, fail, at = self.goto, self.fail, s
        while (n := goto.get(at << 8 | c)) is None and at:
            at = fail[at]
        n = self.steps[s << 8 | c] = n or 0
        return n

    def merges(self, parts: list[bytes]) -> list[bytes]:
        """BPE by its definition: join the pair of lowest rank, leftmost first, while there is one."""
        rank = self.table.get
        while len(parts) > 1:
            best, place = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, place = r, i
            if best is None:
                break
            parts = [*parts[:place], parts[place] + parts[place + 1], *parts[place + 2 :]]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes is the two tokens."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= MAX_PAIRS:
                self.apart.clear()
            x, y = self.bytes[a], self.bytes[b]
            both = x + y
            known = self.merges([both[i : i + 1] for i in range(len(both))]) == [x, y]
            self.apart[a, b] = known
        return known

    def encode_sorted(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all words on end, and the number of each; the words are distinct and sorted."""
        apart, steps, longest, shorter, length = self.apart, self.steps, self.longest, self.shorter, self.length
        last: list[int] = []  # last[i]: the last token of the first i + 1 bytes
        states = [0]
        before = b""
        flat: list[int] = []
        counts: list[int] = []
        for word in words:
            n = len(word)
            k, most = 0, min(n, len(before))
            if word[:most] == before[:most]:
                k = most
            else:
                while word[k] == before[k]:
                    k += 1
            del last[k:], states[k + 1 :]
            s = states[k]
            for i in range(k, n):
                c = word[i]
                m = steps.get(s << 8 | c)
                s = self.step(s, c) if m is None else m
                states.append(s)
                t = longest[s]
                while True:
                    p = i - length[t]
                    # the prefix is a token as a whole, or t follows the last token before it
                    pair = (last[p], t) if p >= 0 else (-1, t)
                    ok = apart.get(pair)
                    if ok is None:
                        ok = self.stay_apart(*pair) if p >= 0 else self.whole(t)
                    if ok:
                        break
                    t = shorter[t]
                last.append(t)
            at = len(flat)
            i = n - 1
            while i >= 0:
                t = last[i]
                flat.append(t)
                i -= length[t]
            many = len(flat) - at
            if many > 1:
                flat[at:] = flat[: at - 1 : -1] if at else flat[::-1]
            counts.append(many)
            before = word
        return flat, counts

    def whole(self, t: int) -> bool:
        """Whether BPE of the token's bytes is the token."""
        word = self.bytes[t]
        known = self.apart[-1, t] = self.merges([word[i : i + 1] for i in range(len(word))]) == [word]
        return known


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(ranks(path))


def trie_pieces(json_path: str | None = None, rank_path: str | None = None, special: int = 50256) -> Encoder:
    """The encoder of distinct pieces for bpe.encode()."""
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    vocab = vocabulary(rank_path or tokenizer_path("byte_bpe_50k.tiktoken"))
    to_byte = {c: b for b, c in byte_signs().items()}

    def split(piece: bytes, plain: bool) -> list[bytes]:
        if piece == SPECIAL:
            return [piece]
        if plain:
            return [w.encode() for w in PLAIN_SPLIT.findall(piece.decode("utf-8"))]
        parts = tokenizer(json_path).pre_tokenizer.pre_tokenize_str(piece.decode("utf-8", "replace"))
        return [bytes(to_byte[c] for c in w) for w, _ in parts]

    def run(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        body, at, plain, joined = sorts_of(pieces)
        sizes = np.diff(at)
        words = pa.array(PLAIN_SPLIT.findall(body[np.repeat(joined, sizes)].tobytes().decode("utf-8")), pa.large_string()).cast(pa.large_binary())
        alone = np.flatnonzero(~joined)
        own = [split(body[at[k] : at[k + 1]].tobytes(), bool(plain[k])) for k in alone]
        ends = np.frombuffer(words.buffers()[1], np.int64)[1 : len(words) + 1] if len(words) else np.zeros(0, np.int64)
        counts = np.zeros(len(sizes), np.int64)
        counts[joined] = np.diff(np.searchsorted(ends, np.cumsum(sizes[joined]), side="right"), prepend=0)
        counts[alone] = [len(x) for x in own]
        mask = np.repeat(joined, counts)
        coded = pa.concat_arrays([words, pa.array([w for x in own for w in x], pa.large_binary())]).dictionary_encode()
        which = coded.indices.to_numpy()
        order = np.empty(len(mask), np.int64)  # the words of `alone` pieces stand last
        order[mask], order[~mask] = which[: len(words)], which[len(words) :]
        ranked = pc.sort_indices(coded.dictionary)
        distinct = coded.dictionary.take(ranked).to_pylist()
        odd = distinct.index(SPECIAL) if SPECIAL in distinct else len(distinct)
        ids, many = vocab.encode_sorted(distinct[:odd])
        if odd < len(distinct):
            more, n_more = vocab.encode_sorted(distinct[odd + 1 :])
            ids, many = [*ids, special, *more], [*many, 1, *n_more]
        flat = np.array(ids, np.uint32)
        lengths, word_at = np.empty(len(many), np.int64), np.empty(len(many), np.int64)
        lengths[ranked.to_numpy()] = many
        word_at[ranked.to_numpy()] = np.cumsum(many) - many
        n = lengths[order]
        out_at = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(word_at[order] - out_at[:-1], n) + np.arange(out_at[-1])]
        return out, out_at[np.concatenate([[0], np.cumsum(counts)])]

    return run


def byte_signs() -> dict[int, str]:
    """The printable sign by which byte-level vocabularies write each byte: itself where it is
    printable, else the next sign from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in signs:
            signs[b] = chr(spare)
            spare += 1
    return signs
