"""Secret scan: trigram inverted index, Boolean trigram queries derived from the rules' regexes, verified candidates.

Each block of documents gets postings of the trigrams that any rule needs. A rule's query (all of, any of) is answered
by intersecting and uniting postings; only its candidates are searched with the regex. Rules without a mandatory
trigram search every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if the group numbered ``part`` has ``least`` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


#: What the base kinds are.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public formats of further credentials.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("urlauth", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

#: Strings a part of a regex may stand for, before it is no longer listed.
MOST = 64


def _grams(s: str) -> frozenset[bytes]:
    """Trigrams, as bytes with ASCII letters in lower case, of a string."""
    b = s.encode("utf-8", "surrogatepass").lower()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def _any_of(strings: set[str]) -> list | None:
    """The query that one of the strings occurs, as a list of alternatives (sets of trigrams); None if it can't tell."""
    found = {_grams(s) for s in strings}
    return None if not found or frozenset() in found else sorted(found, key=sorted)


def _strings(nodes) -> set[str] | None:
    """All strings that the nodes match, or None if they're too many to list."""
    out = {""}
    for op, arg in nodes:
        if op is sre.LITERAL:
            one = {chr(arg)}
        elif op is sre.IN and not any(o in (sre.NEGATE, sre.CATEGORY) for o, _ in arg):
            one = {chr(c) for o, a in arg for c in ((a,) if o is sre.LITERAL else range(a[0], min(a[1], a[0] + MOST) + 1))}
        elif op is sre.SUBPATTERN:
            one = _strings(arg[-1])
        elif op is sre.BRANCH:
            each = [_strings(x) for x in arg[1]]
            one = None if None in each else set().union(*each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
            part = _strings(arg[2])
            one = None if part is None or len(part) ** arg[1] > MOST else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(part, repeat=n)}
        elif op is sre.AT:
            one = {""}
        else:
            one = None
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """What each match needs: all of the list's clauses, in each of which one alternative with all its trigrams.

    An empty list means that nothing is mandatory. Letters count in either case, so the query holds for any flags.
    """
    clauses: list = []

    def visit(nodes) -> None:
        run: list = []

        def flush() -> None:
            if run and (q := _any_of(_strings(run) or set())):
                clauses.append(q)
            run.clear()

        for node in nodes:
            op, arg = node
            if _strings([*run, node]) is not None:
                run.append(node)
                continue
            flush()
            if _strings([node]) is not None:
                run.append(node)
            elif op is sre.SUBPATTERN:
                visit(arg[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
                visit(arg[2])
        flush()

    visit(sre_parser.parse(pattern))
    return clauses


class Scanner:
    """Finds the spans of all rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        # A run that is too short is no match, and no match of such a rule begins inside another run
        self.found = [re.compile(p[:-1] + "{%d,}" % r.least if (p := r.pattern)[0] == "[" and p.endswith("]+") and p.count("[") == 1 and not r.part else p) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        grams = sorted({g for q in self.queries for c in q for alt in c for g in alt})
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, bool)
        self.codes = np.array([int.from_bytes(g, "big") for g in grams], np.uint32)
        self.table[self.codes] = True

    def postings(self, texts: list[bytes]) -> dict[bytes, set[int]]:
        """By trigram that a rule needs, the numbers of the texts that have it."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        out: dict[bytes, set[int]] = {g: set() for g in self.number}
        for at in range(0, max(0, len(raw) - 2), 1 << 22):
            x = raw[at : at + (1 << 22) + 2].astype(np.uint32)
            code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            hits = np.flatnonzero(self.table[code])
            texts_hit = np.searchsorted(ends, hits + at, "right")
            pairs = np.unique(np.searchsorted(self.codes, code[hits]).astype(np.int64) << 32 | texts_hit)
            grams = list(self.number)
            for p in pairs.tolist():
                out[grams[p >> 32]].add(p & 0xFFFFFFFF)
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text, (start, end, number of the rule), by start and then by rule."""
        index = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, found, query) in enumerate(zip(self.rules, self.found, self.queries, strict=True)):
            rows = range(len(texts))
            if query:
                rows = sorted(set.intersection(*(set().union(*(set.intersection(*(index[g] for g in alt)) for alt in c)) for c in query)))
            for i in rows:
                for m in found.finditer(texts[i]):
                    if m.end(rule.part) - m.start(rule.part) >= rule.least:
                        out[i].append((m.start(), m.end(), k))
        for x in out:
            x.sort(key=lambda s: (s[0], s[2]))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, block: int = 512) -> DataFrame:
    """(id, spans) per row of ``docs``; spans: array of (kind, start, end, value) by start, then by rule order.

    Offsets count code points, ends are exclusive. Null texts count as empty and have no spans; repeated rows and null
    ids are kept as they are; texts are searched whole, whatever their length. Empty input: empty result.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                b = whole.slice(at, block)
                texts = [t or "" for t in b.column(1).to_pylist()]
                spans = [[{"kind": rules[k].kind, "start": s, "end": e, "value": t[s:e]} for s, e, k in found] for t, found in zip(texts, scanner.spans(texts), strict=True)]
                yield pa.record_batch([b.column(0), pa.array(spans, pa.list_(item))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,value:string>>")
