"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch of texts are held as one ragged array of symbols. In each step every sequence applies its own
lowest-rank pair, at all places at once (overlaps from the left), until no sequence has a pair with a rank; the
symbols that survive are counted. A merged pair only makes pairs of higher rank, so that the steps give what the
library's queue gives.

Defined cases: a null or empty text has no bytes and no tokens; special strings in a text are one token each, as is the
library's default; ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import per_text, tokenizer_path

#: Distinct pre-tokens whose count a worker remembers between batches; beyond it the memory starts anew.
REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: visible Latin-1 stands for itself."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of pairs of symbols, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.none = len(pairs)
        self.letters = np.array([vocab.get(c, -1) for c in _byte_letters()], dtype=np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        split = spec["pre_tokenizer"]
        if split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without normalisation are supported")
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols to which each piece merges."""
        out = np.array([len(p) for p in pieces], dtype=np.int64)
        owner = np.repeat(np.arange(len(pieces)), out)
        symbols = self.letters[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        while len(symbols) > 1:
            ranks = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), self.none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[ranks, self.none], first)
            hit = (ranks < self.none) & (ranks == np.repeat(lowest, np.diff(np.r_[first, len(owner)]))[:-1])
            # a pair that overlaps the one before it waits: of a run of hits every other one merges
            run_start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            at = np.flatnonzero(hit)
            offset = at - run_start[np.searchsorted(run_start, at, side="right") - 1] if len(at) else at
            at = at[offset % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            # sequences that had no pair left are done
            live = np.repeat(lowest < self.none, np.diff(np.r_[first, len(owner)]))
            done = owner[~live]
            if len(done):
                n = np.bincount(done, minlength=len(pieces))
                out[n > 0] = n[n > 0]
            symbols, owner = symbols[keep & live], owner[keep & live]
        if len(symbols):
            out[owner[0]] = 1
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        pieces: list[str] = []
        ends, extra = [], []
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            for part in parts:
                pieces += self.split.findall(part)
            ends.append(len(pieces))
            extra.append(len(parts) - 1)
        known = self.known
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(pieces))
        if new:
            known.update(zip(new, self.surviving([p.encode("utf-8", "surrogatepass") for p in new]).tolist(), strict=True))
        n = np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        total = np.r_[0, np.cumsum(n)][np.array([0, *ends], dtype=np.int64)]
        return np.diff(total) + np.array(extra, dtype=np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more tokens than limit)."""

    def work(texts: list[str]) -> dict:
        n = load(tokenizer_path(vocabulary)).count(texts)
        return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": n > limit}

    return per_text(docs, id_col, text_col, work, "n_bytes long, n_tokens long, over_limit boolean")
