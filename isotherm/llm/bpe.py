"""Byte-level BPE by forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never be joined by a merge, so a cut between them is
certain. Each pre-token is cut at all such places; the fragments are short, repeat often, and are merged independently
(and remembered per task), then their ids are concatenated. Special-token strings inside a text become the special id,
as the public library does unless told otherwise.

Long fragments are merged with a linked list and a heap (``n log n``), so a word of a million letters costs no square.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from isotherm.llm.common import map_batches, texts

# fixed value: the pre-token pattern of the byte-level vocabulary
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the rank of a pair that no merge joins
NEVER = 1 << 60
#: remembered pre-tokens per worker; the memory is dropped and begun anew when it is full
MEMORY = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else 256 upward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.specials.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.ranks.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self.rank_of = {pair: rank for pair, (rank, _) in self.ranks.items()}
        self.joined = {rank: token for rank, token in self.ranks.values()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.joinable = {pair for token in self.ids for pair in pairwise(token)}
        self.pattern = regex.compile(PRE_TOKEN)
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.memory: dict[str, tuple[int, ...]] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut wherever no token can span the cut."""
        joinable, out, start = self.joinable, [], 0
        for k, pair in enumerate(pairwise(data), 1):
            if pair not in joinable:
                out.append(data[start:k])
                start = k
        out.append(data[start:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair joins first, the leftmost of equals."""
        whole = self.ids.get(fragment)
        if whole is not None and len(fragment) == 1:
            return [whole]
        ids, ranks = [self.byte_ids[b] for b in fragment], self.ranks
        if len(ids) <= 48:
            get = self.rank_of.get
            order = [get(p, NEVER) for p in pairwise(ids)]
            while order:
                least = min(order)
                if least == NEVER:
                    break
                k = order.index(least)
                ids[k : k + 2] = [self.joined[least]]
                del order[k]
                if k:
                    order[k - 1] = get((ids[k - 1], ids[k]), NEVER)
                if k < len(order):
                    order[k] = get((ids[k], ids[k + 1]), NEVER)
            return ids
        count = len(ids)
        after, before, alive = list(range(1, count + 1)), list(range(-1, count - 1)), [True] * count
        heap = [(*ranks[p], k, p) for k, p in enumerate(pairwise(ids)) if p in ranks]
        heap = [(rank, k, joined, p) for rank, joined, k, p in heap]
        heapq.heapify(heap)
        while heap:
            _, k, joined, pair = heapq.heappop(heap)
            right = after[k]
            if not alive[k] or right >= count or (ids[k], ids[right]) != pair:
                continue
            ids[k], alive[right], after[k] = joined, False, after[right]
            if after[k] < count:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < count and (found := ranks.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1], (ids[a], ids[b])))
        return [i for i, kept in zip(ids, alive) if kept]

    def _token(self, token: str) -> tuple[int, ...]:
        """Ids of a pre-token: fragments, then merges. Short ones are remembered, so a full memory has a fixed size."""
        ids = tuple(i for f in self.fragments(token.encode()) for i in self.merge(f))
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        if len(token) <= 64:
            self.memory[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memory, special = self.memory, self.specials
        parts = self.split_specials.split(text) if self.split_specials and any(s in text for s in special) else (text,)
        for part in parts:
            if part in special:
                out.append(special[part])
                continue
            for token in self.pattern.findall(part):
                ids = memory.get(token)
                out += self._token(token) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One vocabulary per worker process; memories of words survive between its tasks."""
    return ByteBPE(path)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded`` of every row. ``vocabulary``: file path, present on every machine.

    A null or empty text has no ids and decodes to the empty text; repeated rows are encoded each.
    """

    def make():
        bpe = load(vocabulary)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id").to_pylist(), "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

        return step

    return map_batches(texts(docs), "doc_id long, ids array<int>, decoded string", make)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: ``n_tokens``, SHA-256 of the ids as little-endian 32-bit integers and of the decoded text."""

    def make():
        bpe = load(vocabulary)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out = {"doc_id": batch.column("doc_id").to_pylist(), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return step

    return map_batches(texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
