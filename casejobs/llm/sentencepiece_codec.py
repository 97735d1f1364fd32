"""SentencePiece encoding and decoding of merge-type (BPE) models with byte fallback.

Encoding is exact and needs no merge loop over the text: an Aho-Corasick automaton gives the pieces that start at each
position, the longest first; a piece may follow the last one only if re-merging the two together gives exactly these
two; a position from which no piece fits is marked in a bit field, and the search backs up to a shorter piece.
No piece has a space mark after another character, and characters outside the vocabulary never merge, so a text falls
into independent runs (spaces and a word, or line ends), whose results are kept in a bounded table per worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

SPACE = "▁"
#: Bytes of results of runs, about, and number of pair checks, that a Python worker keeps at most, from task to task.
KEPT_BYTES = 110_000_000
KEPT_PAIRS = 300_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            value: object = varint()
        elif key & 7 == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """Pieces, scores and types by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file. Only plain BPE models are supported: no character map, a leading space, byte fallback."""
        pieces, scores, types, bpe = [], [], [], False
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, _NORMAL))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the model's text normalisation is not supported")
        if not bpe:
            raise ValueError("not a merge-type model")
        if types.count(_BYTE) != 256 or _USER in types or _UNUSED in types:
            raise ValueError("the model needs byte pieces and may not have user-defined or unused pieces")
        return cls(tuple(pieces), tuple(scores), tuple(types))


class Codec:
    """Encodes and decodes single texts; made once in each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.scores = vocabulary.pieces, vocabulary.scores
        self.types = vocabulary.types
        self.id = {p: i for i, p in enumerate(self.pieces) if self.types[i] == _NORMAL}
        self.characters = {p for p in self.id if len(p) == 1}
        self.end = self.pieces.index("</s>")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space mark after another character")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merge(p) == [i]:  # a piece that its own characters don't merge to is never found
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        self.shorter = [-1] * len(self.pieces)  # the longest piece that is a proper prefix
        for p, i in self.id.items():
            self.shorter[i] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), -1)
        self.digits = [f" {i}" for i in range(len(self.pieces))]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs = _Runs(self)

    def merge(self, text: str) -> list[int] | None:
        """Merges characters by best score, leftmost first; None if a character is not in the vocabulary."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        ids = [self.id.get(p) for p in parts]
        return None if None in ids else ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters together gives these two pieces again."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def backtrack(self, run: str) -> list[int]:
        """Ids of a run whose characters are all in the vocabulary."""
        if len(run) == 1:
            return [self.id[run]]
        size, longest = self.size, [-1] * len(run)
        for end, i in self.automaton.iter(run):  # of the pieces with one start, the longest comes last
            longest[end - size[i] + 1] = i
        pairs, compatible, shorter = self.pairs, self.compatible, self.shorter
        failed = bytearray((len(run) >> 3) + 1)
        out: list[int] = []
        pos, last, i = 0, -1, longest[0]
        while True:
            end = pos + size[i]
            if failed[end >> 3] >> (end & 7) & 1 or last >= 0 and not (pairs.get((last, i)) or compatible(last, i)):
                i = shorter[i]
                while i < 0:  # nothing fits here: mark the position and back up
                    failed[pos >> 3] |= 1 << (pos & 7)
                    i = out.pop()
                    pos -= size[i]
                    last = out[-1] if out else -1
                    i = shorter[i]
                continue
            out.append(i)
            if end == len(run):
                return out
            pos, last, i = end, i, longest[end]

    def encode_run(self, run: str) -> list[int]:
        """Ids of a run; characters outside the vocabulary become bytes."""
        if self.characters.issuperset(run):
            return self.backtrack(run)
        ids: list[int] = []
        known = ""
        for c in run:
            if c in self.id:
                known += c
                continue
            if known:
                ids += self.backtrack(known)
                known = ""
            ids += [self.byte_id[b] for b in c.encode()]
        return ids + self.backtrack(known) if known else ids

    def split(self, text: str) -> list[str]:
        """The text's runs; a space mark in the text is a space."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return _RUN.findall(" " + text) if text else []

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [i for run in self.split(text) for i in self.encode_run(run.replace(" ", SPACE))]
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control pieces are dropped, bytes that are no UTF-8 become U+FFFD, the leading space goes
        (but not one that is given as a byte)."""
        first = next((i for i in ids if self.types[i] != _CONTROL), self.end)
        return self._text(ids) if first in self.byte_of else self._text(ids).removeprefix(" ")

    def _text(self, ids: list[int]) -> str:
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_characters(pending))
                pending.clear()
            if self.types[i] == _UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] != _CONTROL:
                out.append(self.pieces[i].replace(SPACE, " "))
        out.append(_characters(pending))
        return "".join(out)


_ESCAPED = re.compile("[\udc80-\udcff]")


def _characters(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is not part of a character."""
    return _ESCAPED.sub("\ufffd", data.decode(errors="surrogateescape"))


_RUN = re.compile(r" *[^ \n]+|\n+| +")


class _Runs(dict):
    """run -> its ids, as text with a space before each; ``shown`` has the decoded text where it is not the run itself.

    A run that comes for the first time waits in ``once``, and is kept when it comes again, so that the many runs that
    come only once don't drive out the others. A full table begins anew.
    """

    #: Bytes of an entry besides its characters: two objects and the places in the table.
    ENTRY = 210

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.once: dict[str, str] = {}
        self.shown: dict[str, str] = {}
        self.bytes = self.once_bytes = 0

    def __missing__(self, run: str) -> str:
        found = self.once.pop(run, None)
        size = self.ENTRY + 2 * len(run)
        if found is not None:
            self.once_bytes -= size
            if self.bytes >= KEPT_BYTES // 2:
                self.clear()
                self.bytes = 0
            self[run] = found
            self.bytes += size
            return found
        codec = self.codec
        marked = run.replace(" ", SPACE)
        ids = codec.encode_run(marked)
        digits = codec.digits
        found = "".join([digits[i] for i in ids])
        pieces = codec.pieces
        plain = "".join([pieces[i] for i in ids])
        if plain != marked:  # there are bytes in it
            shown = codec._text(ids)
            if shown != run:
                self.shown[run] = shown
        if len(run) <= 64:
            if self.once_bytes >= KEPT_BYTES // 2:
                self.once.clear()
                self.once_bytes = 0
            self.once[run] = found
            self.once_bytes += size
        return found

    def encode(self, text: str) -> tuple[str, str]:
        """(ids, each with a space before it; the decoded text) of a whole text."""
        runs = self.codec.split(text)
        ids = "".join(map(self.__getitem__, runs))
        decoded = "".join([self.shown.get(r, r) for r in runs] if self.shown else runs)
        if len(self.shown) > 10_000:
            for table in (self.shown, self.once, self):
                table.clear()
            self.bytes = self.once_bytes = 0
        return ids, decoded.removeprefix(" ")


_CODECS: dict[str, Codec] = {}


def _codec(key: str, vocabulary: Broadcast) -> Codec:
    """The worker's codec for a vocabulary; the next task in this worker uses it again."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary.value)
    return _CODECS[key]


def sentencepiece_roundtrip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes each whole text (with the end id) and decodes the ids again.

    One row per row of ``docs`` (doc_id, text): n_tokens, ids (decimal, joined by a space) as their SHA-256, and the
    decoded text's SHA-256. Null counts as empty: only the end id. Rows with repeated or null ids are encoded each for
    itself; other columns are left out.
    """
    return _run(docs, model_path, False)


def sentencepiece_encode(docs: DataFrame, model_path: str) -> DataFrame:
    """As ``sentencepiece_roundtrip``, with the ids themselves (``ids`` array<int>) and the decoded text."""
    return _run(docs, model_path, True)


def _run(docs: DataFrame, model_path: str, whole: bool) -> DataFrame:
    loaded = Vocabulary.load(model_path)
    key = hashlib.sha256(repr(loaded).encode()).hexdigest()
    vocabulary = docs.sparkSession.sparkContext.broadcast(loaded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, vocabulary)
        end = str(codec.end)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    ids, decoded = codec.runs.encode(text or "")
                    ids = f"{ids} {end}"[1:]
                    rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([[int(i) for i in ids.split(" ")], decoded] if whole else [])))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns) + 1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if whole else ""
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
