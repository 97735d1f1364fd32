"""Secret scans: rules are regular expressions; a trigram index finds the documents that can match them.

From each rule's pattern a Boolean query over trigrams is derived: every match must hold the trigrams of one of its
literal alternatives. Each batch of documents is an index segment: posting lists of the needed trigrams are built in
one pass over the bytes (case folded), the query is evaluated by intersecting and joining postings, and only candidates
are verified by the pattern. A rule whose pattern has no mandatory trigram scans every document. The index is exact: it
never loses a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _constants as rc
from re import _parser as rp

from .arrays import chunks


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches that do not overlap; those with fewer characters in ``group`` are dropped.

    The secret itself is the match's group ``span``.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    span: int = 0


# A private key in PEM form: from the BEGIN line to the END line, which no other BEGIN or END comes before. Without an
# END line: over known header fields, lines that hold only base64 up to their end or a quote (line breaks may be escaped,
# lines quoted or indented), and runs of at least 40 such characters anywhere behind.
_BREAK = r"(?:\r\n?|\n|\\r|\\n)"
_MARKS = r"[\x20\t>#|*\"'+,;]*+"
_FIELDS = rf"(?:{_MARKS}{_BREAK}{_MARKS}(?:Proc-Type|Content-Domain|DEK-Info):[^\r\n\\]*+)*+"
_LINE = rf"{_MARKS}(?:{_BREAK}{_MARKS})++[A-Za-z0-9+/=]++(?={_MARKS}(?:{_BREAK}|\Z)|[\"'`<])"
_RUN = rf"{_MARKS}(?:{_BREAK}{_MARKS})*+[A-Za-z0-9+/=]{{40,}}+"
_TO_END = r"[^-]*+(?:(?!-----(?:BEGIN|END)\x20)-[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_PRIVATE_KEY = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_FIELDS}(?:{_RUN}|{_LINE})*+)"

# A token of three parts joined by dots. A run of its characters is looked at from its first mark on and from nowhere
# else, so that a long run is gone over once.
_PART = "[A-Za-z0-9_-]"
_JWT = rf"(?<!{_PART})(?>{_PART}*?(?=eyJ))(eyJ{_PART}{{8,}}+\.eyJ{_PART}{{8,}}+\.{_PART}++)"

# The base kinds and published formats of access tokens.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", _JWT, span=1),
    Rule("private_key", _PRIVATE_KEY),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]{4,}+@"),
)


#: A query is True (all documents), a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def _join(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_text(text: str) -> Query:
    """The trigrams that a literal text must hold; folded, as postings are."""
    folded = text.lower()
    return _join("and", [folded[i : i + 3] for i in range(len(folded) - 2)]) if folded.isascii() else True


_MOST_TEXTS = 64


#: Letters that match others outside ASCII where a pattern ignores case.
_OUTSIDE_ASCII = frozenset("iksIKS")


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every document with a match satisfies.

    What is not literal asks for nothing; nor do letters that match others outside ASCII, since postings fold ASCII only.
    """

    def walk(items, flags: int) -> tuple[set[str] | None, Query]:
        """(all texts that the items can match, or None if there are many; the query)"""
        exact: set[str] | None = {""}
        needed: list[Query] = []
        for op, arg in items:
            texts, query = one(op, arg, flags)
            if exact is not None and texts is not None and len(exact) * len(texts) <= _MOST_TEXTS:
                exact = {a + b for a in exact for b in texts}
                continue
            if exact is not None:
                needed.append(_join("or", [_of_text(x) for x in sorted(exact)]))
            needed.append(query)
            exact = texts
        if not needed:
            return exact, _join("or", [_of_text(x) for x in sorted(exact or {""})])
        if exact is not None:
            needed.append(_join("or", [_of_text(x) for x in sorted(exact)]))
        return None, _join("and", needed)

    def loose(c: int, flags: int) -> bool:
        return bool(flags & re.IGNORECASE and not flags & re.ASCII and (c > 127 or chr(c) in _OUTSIDE_ASCII))

    def one(op, arg, flags: int) -> tuple[set[str] | None, Query]:
        if op is rc.LITERAL:
            return None if loose(arg, flags) else {chr(arg)}, True
        if op is rc.IN and len(arg) <= 8 and all(k is rc.LITERAL for k, _ in arg):
            return None if any(loose(c, flags) for _, c in arg) else {chr(c) for _, c in arg}, True
        if op is rc.SUBPATTERN:
            return walk(arg[3], (flags | arg[1]) & ~arg[2])
        if op is rc.BRANCH:
            found = [walk(x, flags) for x in arg[1]]
            texts = set().union(*(t for t, _ in found)) if all(t is not None for t, _ in found) else None
            return texts, _join("or", [q for _, q in found])
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            texts, query = walk(inner, flags)
            if (low, high) == (0, 1) and texts is not None:
                return texts | {""}, True
            if low and low == high == 1:
                return texts, query
            return None, query if low else True
        return ({""} if op is rc.AT else None), True

    parsed = rp.parse(pattern)
    return walk(parsed, parsed.state.flags)[1]


def _grams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(_grams(q) for q in query[1]))


_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32


class Segment:
    """Posting lists of the wanted trigrams over one chunk of documents."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, wanted: dict[str, int], table: np.ndarray):
        self.size = len(off) - 1
        self.posting = {g: np.zeros(0, np.int64) for g in wanted}
        if len(raw) < 3 or not wanted:
            return
        b = _FOLD[raw]
        slot = table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
        at = np.flatnonzero(slot)
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[doc + 1]
        at, doc = at[inside], doc[inside]
        key = np.unique(slot[at].astype(np.int64) * self.size + doc)
        slots, docs = key // self.size, key % self.size
        ends = np.searchsorted(slots, np.arange(1, len(wanted) + 2))
        self.posting = {g: docs[ends[i - 1] : ends[i]] for g, i in wanted.items()}

    def find(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.posting[query]
        found = [self.find(q) for q in query[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    """Rules made ready in a task."""

    def __init__(self, rules: tuple[Rule, ...], queries: list[Query]):
        self.rules, self.queries = rules, queries
        self.wanted = {g: i + 1 for i, g in enumerate(sorted(set().union(*(_grams(q) for q in queries))))}
        self.table = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 256 else np.int32)
        for g, i in self.wanted.items():
            a, b, c = g.encode()
            self.table[(a << 16) | (b << 8) | c] = i
        self.patterns = [re.compile(r.pattern) for r in rules]

    def scan(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[tuple[int, int, int]]], list[str | None]]]:
        """(first row, end row, spans as (start, rule, end), redacted texts), chunk by chunk."""
        texts = batch.column(batch.schema.get_field_index("text"))
        for row, end, raw, off in chunks(batch, "text"):
            own = texts.slice(row, end - row).to_pylist()
            segment = Segment(raw, off, self.wanted, self.table)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in own]
            for i, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns)):
                for d in segment.find(query).tolist():
                    for m in pattern.finditer(own[d] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[d].append((m.start(rule.span), i, m.end(rule.span)))
            for found in spans:
                found.sort()
            yield row, end, spans, [redact(text, found) if found else text for text, found in zip(own, spans)]


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``spans``, an array of (kind, start, end), and the redacted text.

    Starts and ends count code points, the end is exclusive; spans are ordered by start, then by the rule's place.
    ``redacted`` has each run of covered characters replaced by ``[SECRET]``. Null texts count as empty, and their
    redacted text is null. Rows with repeated or null ids are scanned each for itself; other columns are left out.
    """
    queries, kinds = [trigram_query(r.pattern) for r in rules], [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, queries)
        for batch in batches:
            for row, end, spans, clean in scanner.scan(batch):
                out = [[{"kind": kinds[i], "start": a, "end": b} for a, i, b in found] for found in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(out, span), pa.array(clean, pa.string())], ["doc_id", "spans", "redacted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, redacted string")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``, with the texts redacted as in ``secret_scan``."""
    queries = [trigram_query(r.pattern) for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, queries)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for row, end, _, clean in scanner.scan(batch):
                columns = batch.slice(row, end - row).columns
                columns[at] = pa.array(clean, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Replaces runs of covered characters; ``found`` is sorted by start."""
    parts, last = [], 0
    for a, _, b in found:
        if a >= last:
            parts += [text[last:a], "[SECRET]"]
        last = max(last, b)
    return "".join([*parts, text[last:]])
