"""SentencePiece models as weighted transducers: shortest paths encode, pieces decode."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
# Fixed value: what an unknown piece reads back as unless the model says otherwise.
UNKNOWN_TEXT = " \u2047 "
REMEMBERED = 500_000
ROWS_AT_ONCE = 256
CELLS_AT_ONCE = 4_096

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers, or the bytes of anything else."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def mapped_texts(packed: bytes) -> dict[str, str]:
    """The texts that a packed normaliser map replaces, and by what.

    The map is a count of bytes, a double array of that size that spells the sources in UTF-8, and
    the replacements, each ended by a zero. A cell of the array holds in its low byte (and highest bit)
    the byte that leads to it, whether an end hangs off it, and the way to its children; an end holds
    the replacement's place.
    """
    if not packed:
        return {}
    (size,) = struct.unpack_from("<I", packed)
    cells, texts = np.frombuffer(packed, "<u4", size // 4, 4).astype(np.int64), packed[4 + size :]
    children = (cells >> 10) << ((cells >> 6) & 8)
    byte = np.arange(1, 256)
    found, open_, spelt = {}, children[:1], [b""]
    while len(open_):  # one length of sources after the other
        parents, below, longer = [], [], []
        for k in range(0, len(open_), CELLS_AT_ONCE):
            to = open_[k : k + CELLS_AT_ONCE, None] ^ byte
            there = (to < len(cells)) & (cells[np.minimum(to, len(cells) - 1)] & 0x800000FF == byte)
            at, last = np.nonzero(there)
            parents.append(at + k)
            longer.append(last + 1)
            below.append(to[at, last])
        parents, longer, below = map(np.concatenate, (parents, longer, below))
        spelt = [spelt[p] + bytes([c]) for p, c in zip(parents.tolist(), longer.tolist())]
        open_ = below ^ children[below]
        for k in np.flatnonzero(cells[below] >> 8 & 1).tolist():
            start = int(cells[open_[k]]) & 0x7FFFFFFF
            found[spelt[k].decode()] = texts[start : texts.index(0, start)].decode()
    return found


class Normaliser:
    """What a model makes of a text before pieces are sought.

    A transducer whose states are the beginnings of sources: from left to right the longest source
    that stands at a place is replaced, any other character is copied. Behind it, if the model says so,
    a second one of two states drops spaces at the ends and after spaces. At last a space mark may be
    put in front, and every space is written as the mark.
    """

    def __init__(self, rules: dict[str, str], squeeze: bool, prefix: bool):
        self.rules, self.squeeze, self.prefix = rules, squeeze, prefix
        self.longest: dict[str, int] = {}
        for source in rules:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        # a place where a source may stand: one of a character, or its first two characters
        alone = "".join(map(re.escape, sorted(s for s in rules if len(s) == 1)))
        firsts = "".join(map(re.escape, sorted({s[0] for s in rules if len(s) > 1})))
        seconds = "".join(map(re.escape, sorted({s[1] for s in rules if len(s) > 1})))
        starts = [f"[{alone}]"] * bool(alone) + [f"[{firsts}](?=[{seconds}])"] * bool(firsts)
        self.starts = re.compile("|".join(starts)) if starts else None

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(output, copied): replacements, and what stands between them."""
        at = done = 0
        while self.starts and (found := self.starts.search(text, at)):
            at = found.start()
            for n in range(min(self.longest[text[at]], len(text) - at), 0, -1):
                new = self.rules.get(text[at : at + n])
                if new is not None:
                    if done < at:
                        yield text[done:at], True
                    yield new, False
                    at = done = at + n
                    break
            else:
                at += 1
        if done < len(text):
            yield text[done:], True

    def __call__(self, text: str) -> str:
        if not self.squeeze:
            if self.rules:
                text = "".join(part for part, _ in self._parts(text))
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        out, after_space = [], True
        for part, copied in self._parts(text):
            if after_space:
                part = part.lstrip(" ")
            if copied:
                part = re.sub("  +", " ", part)
            if part:
                out.append(part)
                after_space = part[-1] == " "
        if not out:
            return ""
        return ((SPACE if self.prefix else "") + "".join(out).replace(" ", SPACE)).rstrip(SPACE)


class Transducer:
    """The model's normaliser, pieces and byte fallback, ready to be composed with texts.

    The normaliser (``Normaliser``) comes first and has one output for a text. From each place of a normalised text, arcs lead over the pieces that stand
    there, and over a character that is no piece by way of its bytes. In a unigram model
    an arc weighs its piece's negative score. In a BPE model what counts is in which order pairs merge,
    and a sequence of pieces is the one that merging gives just if each two neighbours, merged by
    themselves, stay these two; so arcs weigh nothing, a step between neighbours that would
    merge otherwise weighs infinity, and the one path of finite weight is the shortest.
    """

    def __init__(self, model: bytes):
        self.pieces, self.kind, self.ids, self.scores = [], [], {}, {}
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                if kind in (NORMAL, USER):
                    self.ids[text], self.scores[text] = len(self.pieces), score
                self.pieces.append(text)
                self.kind.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.bpe = {UNIGRAM: False, BPE: True}.get(trainer.get(3, UNIGRAM))
        if self.bpe is None or USER in self.kind or (self.bpe and UNUSED in self.kind):
            raise ValueError("only unigram and BPE models without user-defined or, in BPE, unused pieces are supported")
        if not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("only models that mark spaces, and in front of words, are supported")
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.normalise = Normaliser(mapped_texts(normaliser.get(2, b"")), self.squeeze, self.prefix)
        scores = [self.scores[p] for p, k in zip(self.pieces, self.kind) if k == NORMAL]
        # an unknown character weighs ten more than the heaviest piece
        self.unlikely = 10.0 - min(scores, default=0.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kind)) if k == BYTE}
        self.byte_numbers = frozenset(self.bytes.values())
        self.unknown = self.kind.index(UNKNOWN)
        self.text = [p.replace(SPACE, " ") if k != CONTROL else "" for p, k in zip(self.pieces, self.kind)]
        self.text[self.unknown] = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
        self.characters = {p for p in self.ids if len(p) == 1}
        # where no piece has a mark after another character, a text falls apart before such marks
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.parts = re.compile(r"(?s).+" if inner else f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        self.stay: dict[int, bool] = {}
        self.made: dict[int, tuple[list[str], list[str], list[float]] | None] = {}
        self.known: dict[str, list[int]] = {}

    def _best(self, symbols: list[str]) -> tuple[float, int]:
        """Score and place of the pair that merges next, the left one of equals; none: (-inf, -1)."""
        best, at = -math.inf, -1
        for k in range(len(symbols) - 1):
            score = self.scores.get(symbols[k] + symbols[k + 1])
            if score is not None and score > best:
                best, at = score, k
        return best, at

    @cached_property
    def neighbours(self) -> set[str]:
        """Two characters that stand side by side in some piece."""
        return {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for piece, number in self.ids.items():
            made.add_word(piece, (len(piece), number))
        made.make_automaton()
        return made

    def name(self, number: int) -> str:
        """The piece of a number; beyond them, numbers stand for characters without a piece."""
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def _steps(self, number: int) -> tuple[list[str], list[str], list[float]] | None:
        """First and last symbol of a piece before each merge that makes it, and the merge's score.

        None if merging makes something else of its characters.
        """
        if number not in self.made:
            symbols, steps = list(self.name(number)), ([], [], [])
            while True:
                steps[0].append(symbols[0])
                steps[1].append(symbols[-1])
                score, at = self._best(symbols)
                steps[2].append(score)
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.made[number] = steps if len(symbols) == 1 else None
        return self.made[number]

    def _apart(self, left, right) -> bool:
        """Whether two pieces merge without ever merging over the bound between them.

        The merges of both come in order of their scores, the left one's first of equals; the two
        symbols at the bound would merge where their score is above the left's next and not
        below the right's.
        """
        if left is None or right is None:
            return False
        (_, ends, ahead), (starts, _, behind), i, j = left, right, 0, 0
        while True:
            over = self.scores.get(ends[i] + starts[j])
            if over is not None and over > ahead[i] and over >= behind[j]:
                return False
            if ahead[i] >= behind[j]:
                if ahead[i] == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces are what merging makes of the two together."""
        found = self._apart(self._steps(left), self._steps(right))
        if len(self.stay) < REMEMBERED:
            self.stay[left << 22 | right] = found
        return found

    def _lightest(self, part: str) -> list[int]:
        """The path of least weight, place by place, by the longer piece of equals."""
        n = len(part)
        weight, last = [0.0] + [math.inf] * n, [(0, 0)] * (n + 1)
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, (length, number) in self.automaton.iter(part):
            arcs[end + 1].append((end + 1 - length, number))
        for end, c in enumerate(part, 1):
            if c not in self.characters:
                arcs[end].append((end - 1, len(self.pieces) + ord(c)))
            for start, number in arcs[end]:
                own = -self.scores[self.pieces[number]] if number < len(self.pieces) else self.unlikely
                if weight[start] + own < weight[end]:
                    weight[end], last[end] = weight[start] + own, (start, number)
        out, at = [], n
        while at:
            at, number = last[at]
            out.append(number)
        return out[::-1]

    def _finite(self, part: str) -> list[str]:
        """The only path of finite weight, followed from the end along the longest arcs first.

        Only one such path leads from a place to the end, so a place that none leads to is never
        tried again.
        """
        n = len(part)
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]  # of the pieces that end at a place
        for end, (length, number) in self.automaton.iter(part):
            arcs[end + 1].append((end + 1 - length, number))
        if not self.characters.issuperset(part):
            for end, c in enumerate(part, 1):
                if c not in self.characters:
                    arcs[end].append((end - 1, len(self.pieces) + ord(c)))
        out, places, left, dead, stay = [], [n], [iter(arcs[n])], set(), self.stay
        while at := places[-1]:
            for i, number in left[-1]:
                if i in dead:
                    continue
                if out:
                    found = stay.get(number << 22 | out[-1])
                    if not (self.stays(number, out[-1]) if found is None else found):
                        continue
                out.append(number)
                places.append(i)
                left.append(iter(arcs[i]))
                break
            else:
                dead.add(places.pop())
                left.pop()
                out.pop()
        return out[::-1]

    def _ids(self, part: str) -> list[int]:
        """Piece numbers along the shortest path; characters without a piece go by their bytes."""
        out: list[int] = []
        for number in self._finite(part) if self.bpe else self._lightest(part):
            if number < len(self.pieces):
                out.append(number)
            elif self.bytes:
                out += [self.bytes[b] for b in self.name(number).encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        """Piece numbers of the whole text; an empty text has none.

        Without byte fallback, neighbouring unknown characters are one unknown piece.
        """
        if not text:
            return []
        marked = self.normalise(text)
        known, neighbours, out = self.known, self.neighbours, []
        for part in self.parts.findall(marked):
            found = known.get(part)
            if found is None:
                # no path of finite weight has a piece over two neighbours that no piece holds
                cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in neighbours]
                found = []
                for i, j in zip([0, *cuts], [*cuts, len(part)]):
                    section = part[i:j]
                    ids = known.get(section)
                    if ids is None:
                        ids = self._ids(section)
                        # frequent ones come early, so what is full stays as it is
                        if len(known) < REMEMBERED and j - i <= 64:
                            known[section] = ids
                    found += ids
                if cuts and len(known) < REMEMBERED and len(part) <= 64:
                    known[part] = found
            out += found
        if not self.bytes:
            out = [i for k, i in enumerate(out) if i != self.unknown or not k or out[k - 1] != i]
        return out

    def _bare(self, text: str, ids: list[int]) -> str:
        """Without the mark in front that the normaliser has put, or without all that it would have dropped."""
        if text[:1] != " " or not (self.prefix or self.squeeze):
            return text
        spaces = 0  # those of pieces, not of what stands for an unknown one
        for i in ids:
            own = len(self.text[i]) - len(self.text[i].lstrip(" ")) if i != self.unknown else 0
            spaces += own
            if i == self.unknown or own < len(self.text[i]):
                break
        return text[spaces if self.squeeze else min(spaces, 1) :]

    def decode(self, ids: list[int]) -> str:
        """The text of piece numbers; bytes that are no UTF-8 become replacement characters."""
        if self.byte_numbers.isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids))
            return self._bare(text, ids)
        kind, out, raw = self.kind, [], bytearray()
        for i in ids:
            if kind[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.text[i])
        text = "".join(out) + raw.decode(errors="replace")
        return self._bare(text, ids)


def encode(docs: DataFrame, model: bytes | str | Path = TOKENIZER, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with ``into``: the piece numbers of the whole text.

    ``model`` is a model file's path or content; the driver reads it and its bytes, which are bounded
    by the vocabulary, go to the tasks. Null and empty texts have an empty array. A column named like
    ``into`` is replaced; other columns and repeated rows stay.
    """
    shared = _shared(docs, model)

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Transducer(shared.value)
        for batch in _small(batches):
            found = [made.encode(t or "") for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1])
            yield batch.append_column(into, pa.ListArray.from_arrays(ends, flat))

    if text == into:
        raise ValueError("the numbers need a column of their own")
    kept = docs.drop(into)
    return kept.mapInArrow(ids, T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: bytes | str | Path = TOKENIZER, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with ``into``: the text of the piece numbers; null and empty arrays give an empty text."""
    shared = _shared(rows, model)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Transducer(shared.value)
        for batch in _small(batches):
            column = batch.column(ids)
            numbers = column.flatten().to_numpy(zero_copy_only=False).tolist()
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            found = [made.decode(numbers[a:b]) for a, b in zip([0, *ends], ends)]
            yield batch.append_column(into, pa.array(found, pa.string()))

    kept = rows.drop(into)
    return kept.mapInArrow(texts, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, since numbers take more room as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _shared(df: DataFrame, model: bytes | str | Path):
    data = model if isinstance(model, bytes) else Path(model).read_bytes()
    return df.sparkSession.sparkContext.broadcast(data)
