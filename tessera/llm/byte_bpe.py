"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Two monoids, each reduced as a tree over halves.

Pieces. The value of a text is the list of its pre-tokens. Pieces are matched from left to right and a match depends
only on what follows its start, so (a) a match that ends at least LOOK characters before the end of the left half
stays, whatever follows, and (b) once the matches of the joined text reach a start that the right half has too, all
later ones are the right half's. A join takes the unstable tail of the left half, re-splits it together with a growing
window of the right half until (b) holds, and keeps everything outside.

Tokens. The value of a long piece is its list of token ids. A list of tokens is the encoding of its bytes if and only
if every two neighbours encode to themselves (merges act on pairs, by one fixed order of ranks). A join re-encodes a
window of tokens around the border, and grows it until both of its seams are such stable pairs.

Decoding gives each id its bytes and concatenates up the same kind of tree.

Defined cases: a null or empty text has no tokens and decodes to nothing; ids of rows may be null or repeat; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import column, per_text, tokenizer_path, with_columns

#: Characters after a match's end that can have had a say in it: contractions read two letters, spaces one character.
LOOK = 3
#: Characters of a leaf of the tree over a text, and bytes of a leaf of the tree over one piece.
TEXT_LEAF, PIECE_LEAF = 2048, 64
WINDOW = 64
REMEMBERED = 600_000


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.whole = ranks
        self.known: dict[str, tuple[int, ...]] = {}
        self.stable = lru_cache(maxsize=65536)(self._stable)

    # pieces

    def pieces(self, text: str) -> list[str]:
        if len(text) <= TEXT_LEAF:
            return self.split.findall(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of the concatenation of two texts, from the pieces of each."""
        if not left or not right:
            return left or right
        tail, cut = len(left[-1]), len(left) - 1
        while cut and tail < LOOK:  # left[cut:] is the unstable tail: the piece before it ends LOOK characters ahead of the border
            cut -= 1
            tail += len(left[cut])
        head, tail_text = left[:cut], "".join(left[cut:])
        # starts of the right half's pieces, in positions of the window
        taken, reach, starts = 0, len(tail_text), {}
        parts, want = [tail_text], WINDOW
        while True:
            while taken < len(right) and reach < len(tail_text) + want:
                starts[reach] = taken
                parts.append(right[taken])
                reach += len(right[taken])
                taken += 1
            window = "".join(parts)
            parts, done = [window], taken == len(right)
            again = []
            for m in self.split.finditer(window):
                if not done and m.end() > len(window) - LOOK:
                    break
                if m.start() in starts:
                    return head + again + right[starts[m.start()] :]
                again.append(m.group())
            if done:
                return head + again
            want *= 2

    # tokens of one piece

    def piece(self, raw: bytes) -> tuple[int, ...]:
        found = self.whole.get(raw)
        return (found,) if found is not None else tuple(self.tokens(raw))

    def tokens(self, raw: bytes) -> list[int]:
        if len(raw) <= PIECE_LEAF:
            return self._leaf(raw) if raw else []
        half = len(raw) // 2
        return self.join_tokens(self.tokens(raw[:half]), self.tokens(raw[half:]))

    def _leaf(self, raw: bytes) -> list[int]:
        """The tokens of a short byte string: the neighbours of the lowest rank are merged, the first ones first."""
        rank = self.whole.get
        found = rank(raw)
        if found is not None:
            return [found]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        none = 1 << 60
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return [self.whole[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        return self._leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of the concatenation of two byte strings, from the tokens of each."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            middle = self._leaf(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            left_ok = i == len(left) or self.stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            i, j = (i if left_ok else 2 * i), (j if right_ok else 2 * j)

    # texts

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.known
        for p in self.pieces(text):
            found = known.get(p)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) < 64:
                    known[p] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TEXT_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _codec(vocabulary: str, pattern: str | None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return load(tokenizer_path(vocabulary), pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Per row: id, tokens array<int>."""

    def work(texts: list[str]) -> dict:
        codec = _codec(vocabulary, pattern)
        return {"tokens": [codec.encode(t) for t in texts]}

    return per_text(docs, id_col, text_col, work, "tokens array<int>")


def decode(coded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Per row: id, raw binary; null tokens decode to nothing."""

    def run(batches):
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            raw = [b"" if t is None else codec.decode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    fields = [StructField("id", coded.schema[id_col].dataType), StructField("raw", BinaryType())]
    return coded.select(column(id_col).alias("id"), column(tokens_col).alias("tokens")).mapInArrow(run, StructType(fields)).toDF(id_col, "raw")


def _digest_columns(texts: list[str], vocabulary: str, pattern: str | None) -> dict:
    codec = _codec(vocabulary, pattern)
    out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "exact": []}
    for text in texts:
        ids = codec.encode(text)
        raw = codec.decode(ids)
        found = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), raw == text.encode("utf-8", "surrogatepass")
        for name, value in zip(out, found, strict=True):
            out[name].append(value)
    return out


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Encodes and decodes in one pass. Per row: id, n_tokens, ids_sha256, decoded_sha256, exact (decoded = text)."""
    return per_text(docs, id_col, text_col, lambda texts: _digest_columns(texts, vocabulary, pattern), DIGESTS)


def with_digests(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """All columns of docs, with those of digests; a column of docs with such a name gives way."""

    return with_columns(docs, text_col, lambda texts: _digest_columns(texts, vocabulary, pattern), DIGESTS)
