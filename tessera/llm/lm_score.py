"""Language-model scores from an Elias-Fano n-gram trie.

The corpus is dealt into blocks, the model into shards (exchange.py). A block sends its distinct words, word pairs and
their successors to the shards that own them, with the counts of its training texts. A shard of pairs builds its part
of the trie in compact levels: the pairs (an Elias-Fano sequence of hashes), the start of each pair's successors
(monotone pointers, Elias-Fano), the successors (relative to their pair, Elias-Fano), and quantised values: the count of
a pair, the weight with which it backs off, and the smoothed probability of each successor. The levels lie in one file
that is memory-mapped. Then the shard answers each block by searching the successors of its contexts.

Probabilities, with c for counts in training texts:

    P1(w)     = (c(w) + 1) / (N + V + 1)
    P2(w|v)   = (1 - m) c(vw) / c(v) + m P1(w),  m = c(v)^b / (c(v) + c(v)^b)
    P3(w|uv)  = (c(uvw) - D) / c(uv) + D t / c(uv) P2(w|v),  t: the different successors of uv; the first term only for
                a known successor; D = DISCOUNT

b is such that the sum of c(v)^b over all words is the number of different pairs: c^b stands for the different
successors of a word, which no shard knows. The discount D keeps a passage that was learned once well below one that was
learned several times, which shares of counts alone (1 of 1, 2 of 2) would not. An unseen context leaves the shorter one's probability. The values add to 1
over the words and one unknown word, up to the quantisation (a ten-thousandth of log10).

Nothing of the model is broadcast or collected but the sums of N, V, pairs and a histogram of counts in 64 steps.

Defined cases: a null or empty text is one end token; a null id is never learned from; each row of a repeated id counts
by itself; other columns are ignored; without training texts N and V are 0.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import column, release, stored

SUCCESSOR_BITS = 24
#: What is taken from every count of three words in a row, and given to the words that weren't seen after the two.
DISCOUNT = 0.75
END = X.mix(np.array([0xE0D], dtype=np.uint64))[0]
STEPS = 5000  # of a probability's code for one unit of log10
EXACT, RATIO = 4096, 1.0004  # counts that are kept exactly, and the ratio of the steps beyond them
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: For each byte, where its ones are: entry (byte, r) is the position of the one of rank r.
_ONES = np.array([([j for j in range(8) if i >> j & 1] + [0] * 8)[:8] for i in range(256)], dtype=np.uint8)


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed, high bits in unary. Values may repeat."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = _POP[high.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        self.ones = np.r_[0, np.cumsum(ones)]  # ones before each 64-bit word
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits) // 64 + 2, dtype=np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] |= np.bitwise_or.reduceat(part << off, first)
            over = np.where(off > np.uint64(64 - bits), part >> ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
            low[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
        ends = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(ends[-1]) if n else 0) + 2 + ((universe >> bits) - (int(values[-1]) >> bits) if n else 0)
        flags = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
        flags[ends] = 1
        return EliasFano(n, bits, low, np.packbits(flags, bitorder="little").view(np.uint64))

    def _select(self, before: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Positions of the ones (or zeros) of the given ranks: a word by the counts before it, in it a byte, in it a bit."""
        word = np.minimum(np.searchsorted(before, rank, side="right") - 1, len(self.high) - 1)
        raw = np.ascontiguousarray(~self.high[word] if flip else self.high[word]).view(np.uint8).reshape(-1, 8)
        seen = np.cumsum(_POP[raw], axis=1, dtype=np.uint8)
        left = (rank - before[word]).astype(np.uint8)
        byte = np.minimum((seen <= left[:, None]).sum(axis=1), 7)
        row = np.arange(len(word))
        left -= np.where(byte > 0, seen[row, byte - 1], 0).astype(np.uint8)
        return word * 64 + byte * 8 + _ONES[raw[row, byte], left]

    def _run(self, at: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """How many ones follow each other from each position on; zero: the rank of the next zero."""
        word, off = at >> 6, (at & 63).astype(np.uint64)
        gap = ~(self.high[word] >> off)
        lowest = gap & (~gap + np.uint64(1))
        n = _POP[np.ascontiguousarray(lowest - np.uint64(1)).view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
        over = np.flatnonzero(n >= 64 - off.astype(np.int64))  # on to the next zero, in a later word
        n[over] = self._select(self.zeros, zero[over], True) - at[over]
        return n

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        value = self.low[word] >> off
        spill = self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63))
        return (value | np.where(off > 0, spill, np.uint64(0))) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        if not len(at):
            return np.zeros(0, np.uint64)
        high = (self._select(self.ones, at, False) - at).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._lows(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of the first element that equals each value, or -1: the next greater or equal one is looked up."""
        values = np.asarray(values, dtype=np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ok = np.flatnonzero(high < self.zeros[-1])
        high, want = high[ok], values[ok] & np.uint64((1 << self.low_bits) - 1)
        # the elements with these high bits are the ones between two zeros
        place = np.where(high > 0, self._select(self.zeros, np.maximum(high - 1, 0), True) + 1, 0)
        start = place - high
        stop = start + self._run(place, high)
        # of these the first whose low bits are not less than the wanted ones
        low, high = start, stop.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self._lows(middle) < want[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        hit = np.flatnonzero(low < stop)
        hit = hit[self._lows(low[hit]) == want[hit]]
        out[ok[hit]] = low[hit]
        return out


class Trie:
    """One shard: pairs, pointers, successors and their quantised values, in one block of memory."""

    LEVELS = ("pairs", "pointers", "successors")

    def __init__(self, parts: dict) -> None:
        self.__dict__.update(parts)

    @staticmethod
    def build(pairs: np.ndarray, counts: np.ndarray, owner: np.ndarray, successor: np.ndarray, seen: np.ndarray) -> bytes:
        """pairs: sorted keys with counts; owner, successor: sorted, the pair's number and a successor, with counts."""
        n = len(pairs)
        kinds = np.bincount(owner, minlength=n)
        value = owner.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor
        levels = [EliasFano.build(pairs, 1 << X.FINGERPRINT), EliasFano.build(np.r_[0, np.cumsum(kinds)].astype(np.uint64), max(1, len(owner))), EliasFano.build(value, max(1, n << SUCCESSOR_BITS))]
        total = np.maximum(counts, 1)
        arrays = [count_code(counts), chance_code(DISCOUNT * kinds / total), chance_code((seen - DISCOUNT) / total[owner] if len(owner) else np.zeros(0))]
        head, body = [], []
        for e in levels:
            head += [e.n, e.low_bits, len(e.low), len(e.high)]
            body += [e.low.tobytes(), e.high.tobytes()]
        head += [len(a) for a in arrays]
        return np.array(head, dtype=np.int64).tobytes() + b"".join(body) + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def open(data) -> Trie:
        """data: bytes or a memory map."""
        head = np.frombuffer(data, np.int64, 15)
        at, parts = head.nbytes, {}
        for i, name in enumerate(Trie.LEVELS):
            n, bits, n_low, n_high = head[4 * i : 4 * i + 4].tolist()
            low = np.frombuffer(data, np.uint64, n_low, at)
            high = np.frombuffer(data, np.uint64, n_high, at + 8 * n_low)
            at += 8 * (n_low + n_high)
            parts[name] = EliasFano(n, bits, low, high)
        for name, n in zip(("counts", "backs", "chances"), head[12:].tolist(), strict=True):
            parts[name] = np.frombuffer(data, np.uint16, n, at)
            at += 2 * n
        return Trie(parts)

    def lookup(self, pair: np.ndarray, owner: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs, and of successors of the pairs that owner names; -1 where they aren't.

        A pair's node is found among the pairs; its pointers bound its successors, among which the successor, relative
        to the node, is searched.
        """
        node = self.pairs.find(pair)
        known = np.flatnonzero(node >= 0)
        begin, end = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        begin[known], end[known] = self.pointers.get(node[known]), self.pointers.get(node[known] + 1)
        out = np.full(len(successor), -1, dtype=np.int64)
        ask = np.flatnonzero(end[owner] > begin[owner])
        mine = owner[ask]
        at = self.successors.find(node[mine].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor[ask])
        out[ask] = np.where((at >= begin[mine]) & (at < end[mine]), at, -1)
        return node, out


def count_code(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, dtype=np.float64)
    return np.where(c <= EXACT, c, EXACT + np.round(np.log(np.maximum(c, EXACT) / EXACT) / np.log(RATIO))).astype(np.uint16)


def count_of(code: np.ndarray) -> np.ndarray:
    code = code.astype(np.float64)
    return np.where(code <= EXACT, code, EXACT * RATIO ** np.maximum(code - EXACT, 0))


def chance_code(p: np.ndarray) -> np.ndarray:
    """0: impossible; else 1 + a multiple of -log10."""
    p = np.asarray(p, dtype=np.float64)
    return np.where(p > 0, 1 + np.minimum(np.round(-np.log10(np.maximum(p, 1e-13)) * STEPS), 65_000), 0).astype(np.uint16)


def chance_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** (-(code.astype(np.float64) - 1) / STEPS), 0.0)


class _Grams:
    """The words, pairs and successors of a block, distinct and sorted, with what each token refers to."""

    def __init__(self, texts: list[str], bits: int) -> None:
        hashes, counts = X.word_hashes(texts, X.NOT_SPACE)
        size = counts + 1
        ends = np.cumsum(size) - 1
        self.words = np.empty(int(size.sum()), dtype=np.uint64)
        self.words[ends] = END
        inner = np.ones(len(self.words), dtype=bool)
        inner[ends] = False
        self.words[inner] = hashes
        self.owner = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(self.words)) - np.repeat(ends - size + 1, size)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        self.uni, self.uni_at = np.unique(self.words, return_inverse=True)
        keys = X.shorten(X.combine(self.words[self.second - 1], self.words[self.second]), bits)
        self.pairs, pair_at = np.unique(keys, return_inverse=True)
        self.pair_at = np.full(len(self.words), -1, dtype=np.int64)  # the pair that ends at a token
        self.pair_at[self.second] = pair_at
        relative = X.mix(self.words[self.third]) >> np.uint64(64 - SUCCESSOR_BITS)
        codes = self.pair_at[self.third - 1].astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | relative
        self.successors, self.successor_at = np.unique(codes, return_inverse=True)

    def counted(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        learn = train[self.owner].astype(np.float64)
        count = lambda at, w, n: np.bincount(at, w, n).astype(np.int64)
        return count(self.uni_at, learn, len(self.uni)), count(self.pair_at[self.second], learn[self.second], len(self.pairs)), count(self.successor_at, learn[self.third], len(self.successors))


MESSAGE = "kind int, shard bigint, block bigint, keys binary, n binary, sizes binary, successors binary, seen binary"
ANSWER = "kind int, shard bigint, block bigint, a binary, b binary, c binary, stats array<bigint>"
BUCKETS = 64


def _send(frame: pd.DataFrame, bits: int) -> pd.DataFrame:
    frame = frame.sort_values(["id", "h"], kind="stable")
    g = _Grams(frame["text"].tolist(), bits)
    c1, c2, c3 = g.counted(frame["train"].to_numpy(bool))
    block, rows = int(frame["block"].iloc[0]), []
    # words go whole, as their counts have to be exact
    shard = (g.uni >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g.uni), np.int64)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        rows.append((1, int(shard[a]), block, X.pack_whole(g.uni[a:b]), X.press(X.small(c1[a:b])), None, None, None))
    kinds = np.bincount((g.successors >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), minlength=len(g.pairs))
    start = np.r_[0, np.cumsum(kinds)]
    relative = (g.successors & np.uint64((1 << SUCCESSOR_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    for s, at in X.cut(g.pairs, bits):
        a, b = start[at.start], start[at.stop]
        rows.append((2, s, block, X.pack(X.local_keys(g.pairs[at])), X.press(X.small(c2[at])), X.press(X.small(kinds[at])), relative[a:b].tobytes(), X.press(X.small(c3[a:b]))))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])


def _three_bytes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel().astype(np.uint64)


def _shard_trie(frame: pd.DataFrame) -> tuple[bytes, list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The trie of all messages to a shard, and each message's pairs, the owner of each successor, and successors."""
    keys = [X.unpack(k) for k in frame["keys"]]
    kinds = [X.large(X.unpress(k)) for k in frame["sizes"]]
    successors = [_three_bytes(s) for s in frame["successors"]]
    owners = [np.repeat(np.arange(len(k)), k) for k in kinds]
    every = np.concatenate(keys)
    c2 = np.concatenate([X.large(X.unpress(n)) for n in frame["n"]])
    learned = np.unique(every[c2 > 0])
    at = np.searchsorted(learned, every[c2 > 0])
    counts = np.bincount(at, c2[c2 > 0], len(learned)).astype(np.int64)
    c3 = np.concatenate([X.large(X.unpress(n)) for n in frame["seen"]])
    owner_key = np.concatenate([k[o] for k, o in zip(keys, owners, strict=True)])
    hit = c3 > 0
    node = np.searchsorted(learned, owner_key[hit]).astype(np.uint64)
    value, where = np.unique(node << np.uint64(SUCCESSOR_BITS) | np.concatenate(successors)[hit], return_inverse=True)
    seen = np.bincount(where, c3[hit], len(value)).astype(np.int64)
    return Trie.build(learned, counts, (value >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), value & np.uint64((1 << SUCCESSOR_BITS) - 1), seen), keys, owners, successors


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    shard, kind, blocks, rows = int(frame["shard"].iloc[0]), int(frame["kind"].iloc[0]), frame["block"].tolist(), []
    if kind == 1:
        keys = [X.unpack_whole(k) for k in frame["keys"]]
        words, where = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(where, np.concatenate([X.large(X.unpress(n)) for n in frame["n"]]), len(words)).astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(1, shard, b, X.press(X.small(part)), None, None, None) for b, part in zip(blocks, np.split(c[where], cuts), strict=True)]
        known = c[c > 0]
        bucket = np.minimum(np.log2(np.maximum(known, 1)).astype(int), BUCKETS - 1)
        stats = [int(known.sum()), len(known), 0, *np.bincount(bucket, minlength=BUCKETS).tolist(), *np.bincount(bucket, known, BUCKETS).astype(np.int64).tolist()]
    else:
        data, keys, owners, successors = _shard_trie(frame)
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            del data
            with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                trie = Trie.open(mapped)
                for b, k, o, s in zip(blocks, keys, owners, successors, strict=True):
                    node, at = trie.lookup(k, o, s)
                    pick = lambda values, i: np.where(i >= 0, values[np.maximum(i, 0)] if len(values) else 0, 0)
                    packed = [X.press(pick(v, i).astype(np.uint16).tobytes()) for v, i in ((trie.counts, node), (trie.backs, node), (trie.chances, at))]
                    rows.append((2, shard, b, *packed, None))
                n_pairs = trie.pairs.n
                del trie
        stats = [0, 0, n_pairs] + [0] * (2 * BUCKETS)
    rows.append((0, shard, -1, None, None, None, stats))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def _exponent(words: np.ndarray, tokens: np.ndarray, pairs: int) -> float:
    """b for which the sum of c ** b over all words is the number of pairs, by bisection on the histogram of counts."""
    n, c = words[words > 0], tokens[words > 0] / words[words > 0]
    low, high = 0.0, 1.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (low, b) if (n * c**b).sum() > pairs else (b, high)
    return low


def _blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> tuple[DataFrame, int]:
    # a null id is 0 and marked: pandas has no whole numbers with nulls
    number = column(id_col).cast("bigint")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("no_id"), F.coalesce(column(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train")).withColumn("h", F.xxhash64("text"))
    n_bytes = X.total_bytes(rows, "text")
    scale = X.task_scale(docs.sparkSession)
    return rows.withColumn("block", X.block_of(n_bytes, scale, F.col("id"), F.col("h"))), X.shard_bits(n_bytes, scale)


def model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, trie): the compact levels themselves, one row a shard; Trie.open reads them from a memory map."""
    blocks, bits = _blocks(docs, id_col, text_col, train)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "trie": [_shard_trie(frame)[0]]})

    return blocks.groupBy("block").applyInPandas(lambda f: _send(f, bits), MESSAGE).where("kind = 2").groupBy("shard").applyInPandas(build, "shard bigint, trie binary")


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out (not train), n_tokens, n_known, train_tokens, base_score, score; train: rows to learn from."""
    blocks, bits = _blocks(docs, id_col, text_col, train)
    messages = blocks.groupBy("block").applyInPandas(lambda f: _send(f, bits), MESSAGE)
    answers = stored(messages.groupBy("kind", "shard").applyInPandas(_answer, ANSWER), "answers")
    del messages
    release(docs.sparkSession)  # texts and messages that were shuffled on the way: texts are shuffled once more below
    # a fixed number of sums, whatever the input
    sums = answers.where("kind = 0").select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    stats = np.zeros(3 + 2 * BUCKETS)
    for r in sums.collect():
        stats[r["i"]] = r["n"]
    n_train, n_words, n_pairs = int(stats[0]), int(stats[1]), int(stats[2])
    power = _exponent(stats[3 : 3 + BUCKETS], stats[3 + BUCKETS :], n_pairs)
    columns = ["id", "no_id", "train", "n_tokens", "n_known", "base_score", "score"]

    def finish(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values(["id", "h"], kind="stable")
        g = _Grams(frame["text"].tolist(), bits)
        got = got.sort_values(["kind", "shard"])
        words, pairs = got[got["kind"] == 1], got[got["kind"] == 2]
        joined = lambda column: np.frombuffer(b"".join(map(X.unpress, column)), np.uint16)
        c1 = np.concatenate([X.large(X.unpress(a)) for a in words["a"]])[g.uni_at].astype(np.float64)
        p = base = (c1 + 1) / (n_train + n_words + 1)
        if len(g.second):
            before, c2 = c1[g.second - 1], count_of(joined(pairs["a"]))[g.pair_at[g.second]]
            kinds = np.maximum(before, 1) ** power
            with np.errstate(divide="ignore", invalid="ignore"):
                mass = kinds / (before + kinds)
                mixed = (1 - mass) * np.minimum(c2 / before, 1) + mass * base[g.second]
            p = base.copy()
            p[g.second] = np.where(before > 0, mixed, base[g.second])
        if len(g.third):
            context = g.pair_at[g.third - 1]
            back = chance_of(joined(pairs["b"]))[context]
            chance = chance_of(joined(pairs["c"]))[g.successor_at]
            p = p.copy()
            p[g.third] = np.where(back > 0, chance + back * p[g.third], p[g.third])
        n = len(frame)
        total = lambda x: np.bincount(g.owner, x, n)
        out = pd.DataFrame({"id": frame["id"].to_numpy(), "no_id": frame["no_id"].to_numpy(bool), "train": frame["train"].to_numpy(bool), "n_tokens": np.bincount(g.owner, minlength=n), "n_known": total(c1 > 0).astype(np.int64), "base_score": total(np.log10(base)), "score": total(np.log10(p))})
        return out[columns]

    out = blocks.groupBy("block").cogroup(answers.where("kind > 0").groupBy("block")).applyInPandas(finish, "id bigint, no_id boolean, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
