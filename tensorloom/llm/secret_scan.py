"""Secret scans through an inverted index of the trigrams that the rules cannot match without."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tensorloom.llm.common import lower_ascii, slices, utf8, with_schema


class Rule(NamedTuple):
    """A pattern, and what a match must be to count."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    base: bool = False


# The patterns of the base rules and of well-known key formats.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 6,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20, True),
    Rule("hex", r"[0-9a-f]{24,}", lambda m: True, True),  # the runs of [0-9a-f]+ of 24 characters or more
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

#: Alternatives followed at once when a pattern's strings are listed; beyond, the part counts as unknown.
_ALTERNATIVES = 64

Query = list[list[frozenset[str]]]  # all of: any of: all trigrams of


def trigram_query(pattern: str) -> Query:
    """What a text must contain to match, as far as trigrams tell: a conjunction of alternatives of trigram sets.

    The pattern is read from left to right. As long as its parts have few strings in lower case (letters, small classes,
    options, branches), these are joined; a part that can be too many things ends the run, and the run's strings give one
    alternative each. A run with a string under three characters demands nothing.
    """
    found: Query = []

    def close(run: set[str]) -> set[str]:
        if run and min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            found.append(sorted((s for s in sets if not any(other < s for other in sets)), key=sorted))
        return {""}

    def strings(items) -> set[str] | None:
        """All strings of a part in lower case; None if they are too many."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                own = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                own = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                own = strings(arg[-1])
            elif op is sre.BRANCH:
                parts = [strings(x) for x in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
                one = strings(arg[2])
                own = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in _power(one, n)}
            else:
                own = None
            if own is None or len(out) * len(own) > _ALTERNATIVES or any(not s.isascii() for s in own):
                return None
            out = {a + b for a in out for b in own}
        return out

    run = {""}
    for item in sre_parser.parse(pattern):
        own = strings([item])
        if own is None:
            run = close(run)
        elif len(run) * len(own) > _ALTERNATIVES:
            close(run)
            run = own
        else:
            run = {a + b for a in run for b in own}
    close(run)
    return found


def _power(strings: set[str], n: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(n):
        out = [p + (s,) for p in out for s in strings][: _ALTERNATIVES + 1]
    return out


class Index:
    """Postings of the trigrams that the rules ask for, over a block of texts; candidates come from intersecting them."""

    def __init__(self, rules=RULES):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted({g for _, _, q in self.rules for any_of in q for s in any_of for g in s})
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.codes = np.asarray([ord(g[0]) | ord(g[1]) << 8 | ord(g[2]) << 16 for g in self.grams], np.int64)
        self.first = np.zeros(1 << 16, bool)  # by the first two bytes
        self.first[self.codes & 0xFFFF] = True

    def postings(self, column: pa.Array) -> list[np.ndarray]:
        """For each trigram the rows that hold it, ascending."""
        data, offsets = utf8(column)
        low = lower_ascii(data)
        if len(low) < 3 or not self.grams:
            return [np.zeros(0, np.int64)] * len(self.grams)
        at = np.flatnonzero(self.first[low[:-2].astype(np.uint16) | (low[1:-1].astype(np.uint16) << np.uint16(8))])
        code = low[at].astype(np.int64) | low[at + 1].astype(np.int64) << 8 | low[at + 2].astype(np.int64) << 16
        order = np.argsort(self.codes)
        place = np.minimum(np.searchsorted(self.codes[order], code), len(order) - 1)
        hit = self.codes[order][place] == code
        at, gram = at[hit], order[place[hit]]
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        n = len(column)
        pairs = np.unique(gram[inside] * n + row[inside])
        return np.split(pairs % n if n else pairs, np.searchsorted(pairs, np.arange(1, len(self.grams)) * n))

    def candidates(self, column: pa.Array) -> list[np.ndarray | None]:
        """For each rule the rows that may match; None for a rule that no trigram decides: all rows."""
        lists, out = self.postings(column), []
        for _, _, q in self.rules:
            rows = None
            for any_of in q:
                each = []
                for s in any_of:
                    own = None
                    for g in sorted(s, key=lambda g: len(lists[self.number[g]])):
                        own = lists[self.number[g]] if own is None else np.intersect1d(own, lists[self.number[g]], assume_unique=True)
                    each.append(own)
                union = np.unique(np.concatenate(each))
                rows = union if rows is None else np.intersect1d(rows, union, assume_unique=True)
            out.append(rows)
        return out

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per row the verified matches as (start, rule's place, end), sorted; places are code points."""
        texts = column.to_pylist()
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, ((rule, pattern, _), rows) in enumerate(zip(self.rules, self.candidates(column), strict=True)):
            for i in range(len(texts)) if rows is None else rows.tolist():
                if texts[i]:
                    found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if rule.keep(m)]
        for spans in found:
            spans.sort()
        return found


def redact(text: str, spans: list[tuple[int, int, int]], rules=RULES) -> str:
    """The text with each run of overlapping spans replaced by the kind that starts it."""
    out, at = [], 0
    for start, k, end in spans:
        if start >= at:
            out += (text[at:start], f"[{rules[k].kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, rules=RULES, redacted: bool = False) -> DataFrame:
    """`docs` with n_assign, n_access, n_hex, base_sha256 and spans (and, if asked for, the redacted text).

    A block of rows, as a task reads it, gets an inverted index of the rules' trigrams over whole texts; a rule's
    pattern runs on its candidates alone, or on every text where no trigram is mandatory (hex). Null and empty texts
    have no span. All rows and columns of `docs` stay, but for
    those of these names; nothing is shuffled; an empty table gives no rows.
    """
    docs = docs.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")
    out = with_schema(docs, n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")
    if redacted:
        out = out.add("redacted", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        base = [k for k, r in enumerate(rules) if r.base]
        for batch in slices(batches):
            found = index.scan(batch.column("text"))
            said = [[f"{rules[k].kind}:{a}:{b}" for a, k, b in spans] for spans in found]
            digests = [hashlib.sha256(",".join(w for w, s in zip(words, spans, strict=True) if s[1] in base).encode()).hexdigest() for words, spans in zip(said, found, strict=True)]
            counts = [pa.array([sum(rules[k].kind == kind for _, k, _ in spans) for spans in found], pa.int64()) for kind in ("assign", "access", "hex")]
            cols = [*batch.columns, *counts, pa.array(digests, pa.string()), pa.array([",".join(w) for w in said], pa.string())]
            if redacted:
                cols.append(pa.array([redact(t, s, rules) if s else t for t, s in zip(batch.column("text").to_pylist(), found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return docs.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


ORACLE = None
