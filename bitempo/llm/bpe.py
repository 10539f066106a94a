"""Operator 1: byte-level BPE, encoding and decoding.

A piece (one match of the pre-tokeniser) is a doubly linked list of symbols. A
priority queue holds (merge rank, position); a popped entry whose symbols have
changed since it was pushed is stale and skipped. Decoding concatenates the
vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in that a byte-level vocabulary file uses for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    return {shifted.get(b, chr(b)): b for b in range(256)}


class Vocabulary:
    """Merges and byte strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = {s: bytes(to_byte[c] for c in s) for s in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.strings: dict[int, bytes] = {i: raw[s] for s, i in ids.items()}
        self.special: dict[str, int] = {}
        for t in spec.get("added_tokens", []):
            self.special[t["content"]] = t["id"]
            self.strings[t["id"]] = t["content"].encode()
        self.of_byte = [0] * 256
        for i, b in self.strings.items():
            if len(b) == 1 and i not in self.special.values():
                self.of_byte[b[0]] = i
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a] << 20 | ids[b]] = r
            self.made.append(ids[a + b])
        size = max(self.strings) + 1
        parts = [self.strings.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.pool = np.frombuffer(b"".join(parts), np.uint8)
        decimals = [f"{i},".encode() for i in range(size)]
        self.dec_lengths = np.array([len(p) for p in decimals], np.int64)
        self.dec_starts = np.concatenate([[0], np.cumsum(self.dec_lengths)])[:-1]
        self.dec_pool = np.frombuffer(b"".join(decimals), np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        of_byte, rank, made = self.of_byte, self.rank, self.made
        sym = [of_byte[b] for b in piece]
        n = len(sym)
        if n == 1:
            return sym
        queue = []
        for i in range(n - 1):
            r = rank.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                queue.append(r * n + i)
        if not queue:
            return sym
        heapq.heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            j = after[i]
            left = sym[i]
            if left < 0 or j >= n or rank.get(left << 20 | sym[j]) != r:
                continue  # stale: one of the two symbols was merged away
            new = made[r]
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(new << 20 | sym[k])
                if r is not None:
                    push(queue, r * n + i)
            p = before[i]
            if p >= 0:
                r = rank.get(sym[p] << 20 | new)
                if r is not None:
                    push(queue, r * n + p)
        return [s for s in sym if s >= 0]

    def decode(self, ids) -> bytes:
        """Bytes of the ids' vocabulary strings, one after the other."""
        return gather(self.pool, self.starts, self.lengths, ids)

    def decimals(self, ids) -> bytes:
        """The ids as decimals joined by commas."""
        return gather(self.dec_pool, self.dec_starts, self.dec_lengths, ids)[:-1]


def gather(pool, starts, lengths, ids, block: int = 1 << 18) -> bytes:
    """Concatenation of pool[starts[i]:starts[i] + lengths[i]] over ids, in blocks of bounded memory."""
    out = [b""]
    ids = np.asarray(ids, np.int64)
    for a in range(0, len(ids), block):
        x = ids[a : a + block]
        n = lengths[x]
        ends = np.cumsum(n)
        out.append(pool[np.repeat(starts[x] - (ends - n), n) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
