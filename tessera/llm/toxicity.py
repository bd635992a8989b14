"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. In a clause a lexicon transducer turns words into tags (insult, threat, target, negation,
reported speech); other words are deleted. Three transducers are composed on the tags, each with its states and arcs
listed below: scope (does a negation or a report govern what follows?), aim (does a target stand with the insult or the
threat?) and pattern (which kind of clause was matched). A clause gives a symbol for each
pattern it matches. An insult, a threat or a learned weak insult without a target is a pattern of its own, apart from the
aimed, negated and reported ones; words outside the lexicon give none. A text's features are its capped counts of pattern symbols; their weights come from
a logistic regression around prior weights, so that patterns which the labels never show keep a sensible weight.

The insult lexicon is a list of fixed words and of stems learned from labelled rows, which match with any ending, as
insults are inflected. The fit uses at most `fit_rows`
labelled training rows, those with the smallest hash of their id; texts are scored whole.

Defined cases: null and empty texts match nothing and get the score of the bias; labels of ids without a document, null
labels and repeated label rows (the largest counts) are allowed; without any usable label the prior weights stand; ids
may repeat; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, per_text, stored, sub_batches, with_columns

#: Labelled training rows of the fit, and stems that it may learn.
FIT_ROWS, LEARNED_STEMS = 8_000, 2_000
#: Evidence for a learned insult: different (word before, word after) pairs and different texts in toxic rows, and the
#: shares of toxic texts among the texts that hold it from which it is a weak or a full insult.
LEAST_CONTEXTS, LEAST_TEXTS, WEAK_SHARE, FULL_SHARE = 6, 6, 0.55, 0.95
#: Pieces of words, the most frequent in toxic texts, whose counts in clean texts are looked at.
CANDIDATES = 200_000
#: Letters of a learned stem; after it any ending may follow. A whole word is marked by a final $.
STEM = range(4, 11)
CAP = 3

# Words of each tag, by language.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid imbecile scum trash garbage worthless pathetic disgusting loser losers
clown clowns dumb dumbass fool fools foolish jerk jerks bastard bastards bitch asshole assholes crap retard retarded
filth filthy vermin parasite parasites pig pigs ugly freak freaks coward cowards creep lowlife subhuman savage savages
trottel depp deppen arschloch dummkopf wichser abschaum dreckskerl missgeburt hurensohn
connard connards salaud salope imbécile crétin débile abruti ordure
imbécil estúpido estúpida basura gilipollas cabrón pendejo asqueroso escoria
""".split()
THREATS = """
kill killing murder destroy beat shoot stab hurt hang burn strangle smash bomb lynch exterminate
umbringen töten erschießen verprügeln vernichten
tuer tuerai buter frapper brûler crever
matar matarte golpear quemar destruir
""".split()
TARGETS = """
you your you're youre u yourself he him his she her they them their those these people
du dich dir dein deine ihr euch sie
tu toi te ton ta vous votre ils elles
tú ti tus usted ustedes ellos ellas vosotros
""".split()
NEGATIONS = """
not no never none isn't aren't wasn't don't doesn't didn't won't can't cannot nobody
nicht kein keine keinen niemals nie
pas jamais aucun aucune
nunca jamás ningún ninguna tampoco
""".split()
REPORTS = """
said says saying called calls wrote writes told tells claimed reported quoted quote according alleged
sagte sagt nannte schrieb laut
dit disait appelé selon écrit
dijo dice llamó según escribió
""".split()

PATTERNS = ("insult", "insult_aimed", "threat", "threat_aimed", "insult_negated", "insult_reported", "threat_negated", "threat_reported", "weak_insult", "weak_insult_aimed", "weak_insult_negated", "weak_insult_reported")
PRIOR = np.array([1.5, 2.5, 0.3, 2.0, 0.3, 0.3, 0.0, 0.0, 0.5, 0.8, 0.1, 0.1])
PRIOR_BIAS, PRIOR_PRECISION = -2.0, 0.5

CLAUSE = re.compile(r"[.!?;:\n\r]+|\s[-–—]\s")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


class Transducer:
    """A deterministic transducer: arcs (state, symbol) -> (state, output); a missing arc copies the symbol and stays."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str | None]], start: str) -> None:
        self.arcs, self.start = arcs, start

    def __call__(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for x in symbols:
            state, y = self.arcs.get((state, x), (state, x))
            if y is not None:
                out.append(y)
        return out


# A negation or a report governs the insults and threats after it in its clause; a report governs a later negation too.
SCOPE = Transducer(
    {("free", "N"): ("negated", None), ("free", "R"): ("reported", None), ("negated", "R"): ("reported", None), ("reported", "N"): ("reported", None), ("negated", "N"): ("free", None), ("reported", "R"): ("reported", None)}
    | {(s, x): (s, f"{x}/{s}") for s in ("free", "negated", "reported") for x in "IXW"},
    "free",
)
_TAGS = [f"{x}/{s}" for x in "IXW" for s in ("free", "negated", "reported")]
# A target before or after makes what is said aimed. Run over the tags and then over what is left in reverse.
AIM = Transducer({("open", "T"): ("aimed", "T")} | {("aimed", x): ("aimed", f"{x}/aimed") for x in _TAGS}, "open")
_WORTH = {"I/free/aimed": 1, "I/free": 0, "X/free/aimed": 3, "X/free": 2, "I/negated": 4, "I/reported": 5, "X/negated": 6, "X/reported": 7}
_WORTH |= {"W/free": 8, "W/free/aimed": 9, "W/negated": 10, "W/reported": 11}


def pattern_of(tags: list[str]) -> set[int]:
    """The numbers of the patterns that a clause's tags match: the composition of the transducers."""
    scoped = SCOPE(tags)
    forward = AIM(scoped)
    back = AIM([x.removesuffix("/aimed") for x in reversed(scoped)])[::-1]
    found = set()
    for a, b in zip(forward, back, strict=True):
        if a == "T":
            continue
        plain = a.removesuffix("/aimed")
        aimed = plain if plain.split("/")[1] != "free" or a == b == plain else f"{plain}/aimed"
        found.add(_WORTH[aimed])
    return found


TRIGGERS = frozenset("IXW")


def pieces_of(word: str) -> list[str]:
    """What may be learned from a word: its beginnings, and the word itself."""
    return [word[:k] for k in STEM if k <= len(word)] + [word + "$"]


@dataclass
class Grammar:
    """Lexicon and weights. tags: word -> I (insult), X (threat), T (target), N (negation), R (reported speech).

    stems: learned beginnings of words (or words that end in $) -> I or W (weak insult).
    """

    tags: dict[str, str] = field(default_factory=dict)
    stems: dict[str, str] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    @staticmethod
    def of(stems: dict[str, str] | None = None) -> Grammar:
        tags: dict[str, str] = {}
        for words, tag in ((TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R"), (THREATS, "X"), (INSULTS, "I")):
            tags |= dict.fromkeys(words, tag)
        return Grammar(tags, stems or {})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def tag(self, word: str) -> str:
        """The word's tag, or an empty string."""
        found = self.tags.get(word)
        if found is None and self.stems:
            found = min((t for t in map(self.stems.get, pieces_of(word)) if t), default=None)
        return found or ""

    def features(self, text: str) -> np.ndarray:
        memory = self.__dict__.setdefault("memory", {})
        if len(memory) > 500_000:
            memory.clear()
        out = np.zeros(len(PATTERNS))
        low = text.lower()
        words = set(WORD.findall(low))
        hit = False
        for w in words:
            tag = memory.get(w)
            if tag is None:
                tag = memory[w] = self.tag(w)
            hit |= tag in TRIGGERS
        if not hit:
            return out
        for clause in CLAUSE.split(low):
            tags = [t for t in (memory[w] for w in WORD.findall(clause)) if t]
            if not TRIGGERS.isdisjoint(tags):
                for k in pattern_of(tags):
                    out[k] += 1
        return np.minimum(out, CAP)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + features @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
    """The weights and bias of largest posterior, from rows of features with counts; Newton's method."""
    x1 = np.c_[np.ones(len(x)), x]
    prior = np.r_[PRIOR_BIAS, PRIOR]
    precision = np.r_[1e-3, np.full(len(PRIOR), PRIOR_PRECISION)]
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (positive - n * p) - precision * (w - prior)
        hess = (x1 * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x1 + np.diag(precision)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[1:], float(w[0])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most fit_rows labelled rows for which fold(id column) is true."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & fold(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    # at most fit_rows ids and flags, so that this side has a proven bound
    return docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marks), "__id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold=None, fit_rows: int = FIT_ROWS) -> Grammar:
    """Learns insults and weights from the labelled rows for which fold(id) is true (by default all)."""
    rows = stored(training_rows(docs, labels, id_col, text_col, label_col, fold or (lambda c: F.lit(True)), fit_rows).distinct(), "labelled")

    def counted(candidates: frozenset | None):
        """Texts that hold each piece of a word, by class; only of the candidates, if there are any."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count: dict = {}
            for part in sub_batches(frames, "text"):
                for text, toxic in zip(part["text"], part["toxic"], strict=True):
                    pieces = {p for w in set(WORD.findall(text.lower())) for p in pieces_of(w)}
                    for p in pieces if candidates is None else pieces & candidates:
                        count.setdefault(p, [0, 0])[int(toxic == 1)] += 1
                if len(count) > 1 << 20:
                    yield _counts(count)
                    count = {}
            yield _counts(count)

        return run

    schema = "stem string, clean bigint, toxic bigint"
    held = rows.where("toxic = 1").mapInPandas(counted(None), schema).groupBy("stem").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_TEXTS)
    candidates = frozenset(r["stem"] for r in held.orderBy(F.desc("toxic"), "stem").limit(CANDIDATES).collect())
    counts = rows.mapInPandas(counted(candidates), schema).groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.where(F.col("toxic") >= WEAK_SHARE * (F.col("clean") + F.col("toxic")))
    likely = {r["stem"]: r["toxic"] / (r["clean"] + r["toxic"]) for r in counts.orderBy(F.desc("toxic"), "stem").limit(8 * LEARNED_STEMS).collect()}

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sub_batches(frames, "text"):
            seen: set = set()
            for text in part["text"]:
                words = WORD.findall(text.lower())
                for a, w, c in zip(["", *words], words, [*words[1:], ""], strict=False):
                    seen.update((p, hash_pair(a, c)) for p in pieces_of(w) if p in likely)
            yield pd.DataFrame(sorted(seen), columns=["stem", "context"]).astype({"context": "int64"})

    often = rows.where("toxic = 1").mapInPandas(contexts, "stem string, context bigint").distinct().groupBy("stem").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    stems: dict[str, str] = {}
    for p in sorted((r["stem"] for r in often.orderBy(F.desc("n"), "stem").limit(LEARNED_STEMS).collect()), key=lambda p: (len(p), p)):
        tag = "I" if likely[p] >= FULL_SHARE else "W"
        shorter = [stems[q] for q in (p[:k] for k in range(STEM.start, len(p))) if q in stems]
        if "I" not in shorter and (tag == "I" or not shorter):
            stems[p] = tag
    grammar = Grammar.of(stems)

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in sub_batches(frames, "text"):
            x = np.array([grammar.features(t) for t in part["text"]]).astype(int)
            yield pd.DataFrame({"shape": [",".join(map(str, r)) for r in x], "toxic": (part["toxic"] == 1).astype("int64").to_numpy()})

    # at most (CAP + 1) ** len(PATTERNS) shapes, whatever the input
    table = rows.mapInPandas(shapes, "shape string, toxic bigint").groupBy("shape").agg(F.count("*").alias("n"), F.sum("toxic").alias("positive")).collect()
    if table:
        x = np.array([[int(v) for v in r["shape"].split(",")] for r in table], dtype=float)
        grammar.weights, grammar.bias = _logistic(x, np.array([r["n"] for r in table], float), np.array([r["positive"] for r in table], float))
        grammar.weights = np.maximum(grammar.weights, 0)
    return grammar


def _counts(count: dict) -> pd.DataFrame:
    return pd.DataFrame([(w, a, b) for w, (a, b) in count.items()], columns=["stem", "clean", "toxic"])


def hash_pair(a: str, b: str) -> int:
    """The same on every worker, unlike Python's hash of strings."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted, patterns (counts of matched clauses in the order of PATTERNS)."""

    def work(texts: list[str]) -> dict:
        x = np.array([grammar.features(t) for t in texts])
        p = grammar.score(x)
        return {"score": p, "predicted": (p >= 0.5).astype("int32"), "patterns": list(x.astype("int32"))}

    return per_text(docs, id_col, text_col, work, "score double, predicted int, patterns array<int>")


def training_fold(c):
    """Rows that may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(c.cast("string")) % 5 != 0


def kept(docs: DataFrame, grammar: Grammar, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is below `least`, with all their columns."""

    def work(texts: list[str]) -> dict:
        return {"__score": grammar.score(np.array([grammar.features(t) for t in texts]))}

    return with_columns(docs, text_col, work, "__score double").where(F.col("__score") < least).drop("__score")
