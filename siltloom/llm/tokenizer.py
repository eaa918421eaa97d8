"""Encoding of texts with a public byte-level BPE tokenizer (problem 8).

Method: speculate and verify. A greedy longest match proposes the tokens of a word. A sequence of tokens is the
encoding that the merges give exactly if every token encodes to itself and every two neighbours are compatible,
that is, their bytes together encode to just these two tokens. So the neighbours of all proposals of a batch are
checked at once, as pairs in arrays (each pair is worked out once), and only words with a failing pair are merged
exactly.

The vocabulary's folder is a parameter; the files are read where the tasks run and are never copied.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from siltloom.session import bound_arrow, spread

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Splits text into words before the merges. Fixed value of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in a worker; beyond it the store starts anew, so memory stays bounded.
MAX_WORDS = 300_000
#: Pairs of tokens kept likewise.
MAX_PAIRS = 1_000_000
#: Words longer than this are not kept.
MAX_KEPT = 64


class SpeculativeBpe:
    """Encoder over a rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str):
        import regex

        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of: dict[int, bytes] = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.size = max(self.bytes_of) + 1
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.pairs = np.empty(0, np.int64)  # known pairs, sorted
        self.fits = np.empty(0, bool)
        self.whole: dict[int, bool] = {}
        self.merged = self.proposed = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, lowest first and leftmost among equals; a heap over a linked list, so long words stay fast."""
        ranks, n = self.ranks, len(word)
        if n == 1:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != r:
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p, a in zip(parts, alive) if a]

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        ranks, longest, n = self.ranks, self.longest, len(word)
        out, i = [], 0
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                t = ranks.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def _self(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.exact(self.bytes_of[token]) == [token]
        return ok

    def _check(self, asked: np.ndarray) -> np.ndarray:
        """Are the pairs (left * size + right) compatible? Unknown ones are worked out once and kept."""
        unique = np.unique(asked)
        if len(self.pairs) > MAX_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        new = unique[~np.isin(unique, self.pairs, assume_unique=True)]
        if len(new):
            left, right = np.divmod(new, self.size)
            found = np.fromiter(
                (self._self(a) and self._self(b) and self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist())), bool, len(new)
            )
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, found)
        return self.fits[np.searchsorted(self.pairs, asked)]

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """Encode distinct words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.greedy(b) for b in raw]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        bad = np.zeros(len(words), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), sizes)
            inside = owner[1:] == owner[:-1]
            ok = self._check(flat[:-1][inside] * self.size + flat[1:][inside])
            bad[owner[1:][inside][~ok]] = True
        for i in np.flatnonzero(sizes == 1):
            if not self._self(int(flat[ends[i] - 1])):
                bad[i] = True
        self.proposed += len(words)
        self.merged += int(bad.sum())
        for i in np.flatnonzero(bad):
            proposals[i] = self.exact(raw[i])
        return dict(zip(words, proposals))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text, without special tokens; none for an empty text and for None."""
        split = [self.split(t) if t else [] for t in texts]
        store = self.words
        new = {w for ws in split for w in ws if w not in store}
        if len(store) + len(new) > MAX_WORDS:
            store.clear()
            new = {w for ws in split for w in ws}
        found = self.learn(list(new)) if new else {}
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += found[w] if w in found else store[w]
            out.append(ids)
        store.update((w, ids) for w, ids in found.items() if len(w) <= MAX_KEPT)
        return out


@lru_cache(4)
def encoder(folder: str = FOLDER, name: str = NAME) -> SpeculativeBpe:
    """One encoder a worker process. Where the folder is not on the machine, the file that Spark sent is taken."""
    path = os.path.join(folder, f"{name}.tiktoken")
    return SpeculativeBpe(path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken"))


#: Texts encoded together; their ids are handed on before the next ones.
_STEP = 256


def encode(documents: DataFrame, folder: str = FOLDER, name: str = NAME, only_count: bool = False) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``) of every document.

    Empty and null texts have an empty list (0 tokens). Whole texts are encoded, however long. Special tokens'
    strings in a text are ordinary text. Other columns of any name are left out; repeated rows give rows each.
    """
    bound_arrow(documents.sparkSession)
    documents.sparkSession.sparkContext.addFile(os.path.join(folder, f"{name}.tiktoken"))  # once a session; only the driver needs the folder

    def run(batches):
        bpe = encoder(folder, name)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if only_count:
                    value = pa.array(sizes)
                else:
                    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                    flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=["doc_id", "n_tokens" if only_count else "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint" if only_count else "doc_id bigint, ids array<int>")
