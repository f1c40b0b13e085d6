"""Byte-level BPE over whole Arrow batches.

Texts are cut where the vocabulary's split pattern always cuts (before white space that follows
a letter, digit or sign), equal pieces are found by Arrow's dictionary encoding, and only the
distinct pieces of a batch are encoded. Their ids are then laid out again by numpy.

``encode`` takes the encoder of distinct pieces as an argument: ``library_pieces`` (the rank
library, and the tokenizers library for pieces with characters for which the two could differ)
or the trie of ``trie.py``. Both give the ids of the tokenizers library.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from rillstack.llm.common import tokenizer_path

SPECIAL = b"<|endoftext|>"
#: A piece holds no other than these characters' bytes if both libraries surely split it alike:
#: ASCII and U+00C0 to U+027F.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[:128] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC3:0xCA] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: The distinct pieces to their ids: (pieces) -> (ids on end, offsets).
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@cache
def rank_library(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@cache
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def token_bytes(path: str, special: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens on end, by id, and their offsets."""
    table = {i: b for b, i in ranks(path).items()} | {special: SPECIAL}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in parts])]).astype(np.int64)


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start bytes of the pieces of all texts, and the end of the data."""
    if len(data) == 0:
        return np.zeros(1, np.int64)
    cut = _SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = (data[:-1] < 128) & ~cut[:-1]
    if len(data) > 2:
        before[2:] |= (data[1:-1] >= 128) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    cut &= before
    cut[at[:-1][at[:-1] < len(data)]] = True
    cut = np.append(cut, True)
    for start in special_places(data, at):
        cut[[start, start + len(SPECIAL)]] = True
        cut[start + 1 : start + len(SPECIAL)] = False
    return np.flatnonzero(cut)


def special_places(data: np.ndarray, at: np.ndarray) -> list[int]:
    """Where the special string stands within one text."""
    whole, found, place = data.tobytes(), [], 0
    while (place := whole.find(SPECIAL, place)) >= 0:
        k = int(np.searchsorted(at, place, side="right"))
        if place + len(SPECIAL) <= at[k]:
            found.append(place)
            place += len(SPECIAL)
        else:
            place += 1
    return found


def encode(data: np.ndarray, at: np.ndarray, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts on end, and for each text the number of ids before it."""
    piece_at = cuts(data, at)
    n = len(piece_at) - 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(piece_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    which = coded.indices.to_numpy()
    ids, id_at = encoder(coded.dictionary)
    counts = np.diff(id_at)[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    out = ids[np.repeat((id_at[:-1][which] - ends[:-1]).astype(kind), counts) + np.arange(ends[-1], dtype=kind)]
    return out, ends[np.searchsorted(piece_at, at)]


def count(data: np.ndarray, at: np.ndarray, encoder: Encoder) -> np.ndarray:
    """The number of ids of each text."""
    piece_at = cuts(data, at)
    n = len(piece_at) - 1
    if n <= 0:
        return np.zeros(len(at) - 1, np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(piece_at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    _, id_at = encoder(coded.dictionary)
    ends = np.concatenate([[0], np.cumsum(np.diff(id_at)[coded.indices.to_numpy()])])
    return np.diff(ends[np.searchsorted(piece_at, at)])


def sorts_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of distinct pieces; which are plain, and which of those may stand on end
    in one text without changing how they split."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    odd = np.concatenate([[0], np.cumsum(~_PLAIN[body])])
    plain = odd[at[1:]] == odd[at[:-1]]
    last = body[at[1:] - 1]
    return body, at, plain, plain & _SPACE[body[at[:-1]]] & ~_SPACE[last]


def library_pieces(json_path: str | None = None, rank_path: str | None = None, special: int = 50256) -> Encoder:
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    rank_path = rank_path or tokenizer_path("byte_bpe_50k.tiktoken")
    fast, exact = rank_library(rank_path), tokenizer(json_path)
    _, token_at = token_bytes(rank_path, special)
    lengths = np.diff(token_at)

    def run(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        body, at, plain, joined = sorts_of(pieces)
        sizes = np.diff(at)
        text = body[np.repeat(joined, sizes)].tobytes().decode("utf-8")
        ids = np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32) if text else np.zeros(0, np.uint32)
        ends = np.cumsum(lengths[ids])
        upto = np.searchsorted(ends, np.cumsum(sizes[joined]), side="right")
        counts = np.zeros(len(sizes), np.int64)
        counts[joined] = np.diff(upto, prepend=0)
        alone = np.flatnonzero(~joined)
        own = []
        for k in alone:
            piece = body[at[k] : at[k + 1]].tobytes()
            if piece == SPECIAL:
                own.append([special])
            elif plain[k]:
                own.append(fast.encode_ordinary(piece.decode("utf-8")))
            else:
                own.append(exact.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)
        counts[alone] = [len(x) for x in own]
        id_at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(id_at[-1], np.uint32)
        mask = np.repeat(joined, counts)
        out[mask] = ids
        out[~mask] = np.fromiter((i for x in own for i in x), np.uint32, int(counts[alone].sum()))
        return out, id_at

    return run


def decode(ids: np.ndarray, id_at: np.ndarray, rank_path: str | None = None, special: int = 50256) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offset of each."""
    table, token_at = token_bytes(rank_path or tokenizer_path("byte_bpe_50k.tiktoken"), special)
    sizes = np.diff(token_at)[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = table[np.repeat(token_at[:-1][ids] - ends[:-1], sizes) + np.arange(ends[-1])]
    return data, ends[id_at]
