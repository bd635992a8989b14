"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: a conjunction over the parts that every match
must hold of disjunctions over the alternatives. An index of postings (trigram -> texts of the batch) answers the
queries; only candidates are verified by the expression. A rule without mandatory trigrams scans every text.

Defined cases: a null text is empty and has no spans; an id may be null or repeat, each row is scanned by itself; extra
columns are ignored; spans are in code points, end exclusive, ordered by start, then by the rules' order.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text

try:  # the parser's module moved in Python 3.11
    from re import _constants as sre_constants
    from re import _parser as sre_parser
except ImportError:  # pragma: no cover
    import sre_constants
    import sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. measure: the group whose length counts (0: the match), least: the least such length."""

    kind: str
    pattern: str
    measure: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


# The three kinds whose counts the query reports, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, fold=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", r"[0-9a-f]+", 0, 24, base=True),
)
# Further kinds that this operator adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES

#: A class of more characters than this breaks a literal, rather than multiplying it out.
WIDEST_CLASS = 6
MOST_STRINGS = 64


def _trigrams(text: str) -> frozenset:
    raw = text.encode().lower()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


def _alternatives(node) -> set[str] | None:
    """All strings that a parsed part can match, if they are few; None otherwise."""
    op, arg = node
    if op is sre_constants.LITERAL:
        return {chr(arg)}
    if op is sre_constants.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre_constants.LITERAL:
                found.add(chr(value))
            elif kind is sre_constants.RANGE and value[1] - value[0] < WIDEST_CLASS:
                found.update(map(chr, range(value[0], value[1] + 1)))
            else:
                return None
        return found if len(found) <= WIDEST_CLASS else None
    if op is sre_constants.SUBPATTERN:
        return _strings(arg[-1])
    if op is sre_constants.BRANCH:
        parts = [_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[1] <= 2:
        inner = _strings(arg[2])
        return None if inner is None else {x * n for x in inner for n in range(arg[0], arg[1] + 1)}
    return None


def _strings(parts) -> set[str] | None:
    out = {""}
    for node in parts:
        more = _alternatives(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[frozenset]]:
    """A conjunction of disjunctions of trigram sets, on ASCII-lower-cased bytes; [] if nothing is mandatory.

    Runs of parts with few strings are multiplied out; a run constrains only if each of its strings has a trigram.
    """
    clauses, run = [], {""}

    def close() -> None:
        sets = frozenset(_trigrams(x) for x in run)
        if all(sets):
            clauses.append(sets)

    for node in sre_parser.parse(pattern):
        more = _alternatives(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        run = {""} if more is None else set(more)
        op, arg = node
        if more is None and op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT) and arg[0] >= 1:
            run = {""}  # its content is mandatory, but too wide to say as trigrams
    close()
    return clauses


@lru_cache(maxsize=8)
def _plan(rules: tuple[Rule, ...]):
    """Compiled expressions, queries, and the table that marks the trigrams which any query mentions."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries for clause in q for s in clause for t in s})
    mark = np.zeros(1 << 24, dtype=np.int16)
    for i, t in enumerate(wanted):
        mark[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    number = {t: i + 1 for i, t in enumerate(wanted)}
    plain = [[[sorted(number[t] for t in s) for s in clause] for clause in q] for q in queries]
    return [r.regex() for r in rules], plain, mark, len(wanted)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(texts: list[bytes], mark: np.ndarray, n: int) -> list[np.ndarray]:
    """For each wanted trigram, the sorted positions in the batch of the texts that hold it."""
    joined = _FOLD[np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 2 for t in texts])
    wide = joined.astype(np.uint32)
    hit = mark[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
    at = np.flatnonzero(hit)
    pairs = np.unique(hit[at].astype(np.int64) << 40 | np.searchsorted(ends, at, side="right"))
    which, text = pairs >> 40, pairs & ((1 << 40) - 1)
    cuts = np.searchsorted(which, np.arange(1, n + 2))
    return [np.empty(0, np.int64), *(text[cuts[i] : cuts[i + 1]] for i in range(n))]


def candidates(query: list, lists: list[np.ndarray], n_texts: int) -> np.ndarray:
    """Positions of the texts that satisfy a query."""
    found = np.ones(n_texts, dtype=bool)
    for clause in query:
        any_of = np.zeros(n_texts, dtype=bool)
        for need in clause:
            rest = lists[need[0]]
            for t in need[1:]:
                rest = rest[np.isin(rest, lists[t], assume_unique=True)]
            any_of[rest] = True
        found &= any_of
    return np.flatnonzero(found)


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, number of the rule, end), sorted."""
    if not texts:
        return []
    regexes, queries, mark, n = _plan(tuple(rules))
    lists = postings([t.encode("utf-8", "surrogatepass") for t in texts], mark, n) if n else []
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries, strict=True)):
        for i in candidates(query, lists, len(texts)) if query else range(len(texts)):
            for m in regex.finditer(texts[i]):
                if m.end(rule.measure) - m.start(rule.measure) >= rule.least:
                    spans[i].append((m.start(), k, m.end()))
    for found in spans:
        found.sort()
    return spans


def _columns(texts: list[str], rules: tuple[Rule, ...]) -> dict:
    spans = scan_texts(texts, rules)
    name = [r.kind for r in rules]
    said = lambda found: ",".join(f"{name[k]}:{a}:{b}" for a, k, b in found)
    out: dict = {f"n_{r.kind}": [sum(k == i for _, k, _ in s) for s in spans] for i, r in enumerate(rules) if r.base}
    out["base_sha256"] = [hashlib.sha256(said([x for x in s if rules[x[1]].base]).encode()).hexdigest() for s in spans]
    out["spans"] = [said(s) for s in spans]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, the count of each base kind, a digest of the base spans, and all spans as kind:start:end."""
    counts = "".join(f"n_{r.kind} long, " for r in rules if r.base)
    return per_text(docs, id_col, text_col, lambda texts: _columns(texts, rules), f"{counts}base_sha256 string, spans string")
