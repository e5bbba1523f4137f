"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked for the loss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

START, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
PART_CHARS = 1_000_000
#: Characters that the tokenizer holds at once, unless a turn is longer; its state takes far more room than its result.
RUN_CHARS = 50_000


def escape(text: str) -> str:
    r"""``text`` without ``<|``: one backslash more between the two characters."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: one backslash less."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@dataclass
class Part:
    """Consecutive turns of a conversation: the text and the sorted spans that the loss counts."""

    conversation: int | None
    number: int
    texts: list[str] = field(default_factory=list)
    size: int = 0
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def add(self, role: str, text: str, counts: bool) -> None:
        head, body = f"{START}{escape(role)}{BODY}", escape(text)
        if counts and body:
            self.starts.append(self.size + len(head))
            self.ends.append(self.size + len(head) + len(body))
        self.texts.append(f"{head}{body}{END}")
        self.size += len(self.texts[-1])

    def runs(self, chars: int) -> Iterator[str]:
        """The part in pieces of whole turns, each closed by the turn with which it reaches ``chars``."""
        own, size = [], 0
        for text in self.texts:
            own.append(text)
            size += len(text)
            if size >= chars:
                yield "".join(own)
                own, size = [], 0
        if own:
            yield "".join(own)


def tokens(part: Part, made: Tokenizer, chars: int = RUN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a part; marks are tokens of their own, so its runs encode as the whole does."""
    ids, offsets, at = [], [], 0
    for run in part.runs(chars):
        code = made.encode(run, add_special_tokens=False)
        ids.append(np.array(code.ids, dtype=np.int32))
        offsets.append(np.array(code.offsets, dtype=np.int64).reshape(-1, 2) + at)
        at += len(run)
    return np.concatenate(ids), np.concatenate(offsets)


def loss_mask(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span; both lists are sorted and tokens do not cross a span's bounds.

    For every span a binary search finds its first token and the one after its last; tokens of one
    character share its offsets, and so are in or out together.
    """
    first = np.searchsorted(starts, span_starts, side="left")
    after = np.searchsorted(starts, span_ends, side="left")
    if np.any(ends[after[after > first] - 1] > span_ends[after > first]):
        raise ValueError("a token crosses the bounds of a turn")
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, after, -1)
    return np.cumsum(change[:-1]) > 0


def encoder(tokenizer: str) -> Tokenizer:
    """The tokenizer with the template's marks as tokens of their own and exact offsets."""
    made = Tokenizer.from_str(tokenizer)
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    made.add_special_tokens([START, BODY, END])
    return made


def format_chats(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learned: Iterable[str] = ("assistant",),
    tokenizer: str | Path = TOKENIZER,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(key, part, text, ids, starts, ends, loss): conversations rendered, encoded and masked.

    Turns are in order of ``turn``, then role and text, nulls first; repeated turns stay; a null role or
    text is empty; a null key is a conversation. ``text`` is the rendered part, ``ids`` its
    tokens, ``starts`` and ``ends`` their code points in it, ``loss`` which of them are in the texts of
    ``learned`` roles. A conversation has one part, unless it is longer than ``part_chars``: parts end
    with a turn, and as marks are tokens of their own, the tokens of the parts are those of the
    whole. Parts of a conversation follow one another in one partition, in order.

    Rows are dealt out by conversation, sorted by Spark, which spills, and streamed, so a task holds
    one part at a time however long a conversation is. An empty table gives an empty result.
    """
    model, roles = encoder(Path(tokenizer).read_text()), frozenset(learned)
    # a worker keeps what was broadcast, so it reads the model once and not for every task
    shared = turns.sparkSession.sparkContext.broadcast(model)

    def encoded(parts: list[Part], made: Tokenizer) -> pa.RecordBatch:
        texts = ["".join(p.texts) for p in parts]
        ids, starts, ends, loss = [], [], [], []
        for part in parts:
            numbers, offsets = tokens(part, made)
            ids.append(numbers)
            starts.append(offsets[:, 0])
            ends.append(offsets[:, 1])
            spans = (np.array(x, dtype=np.int64) for x in (part.starts, part.ends))
            loss.append(loss_mask(offsets[:, 0], offsets[:, 1], *spans))
        whole, places = pa.list_(pa.int32()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p.conversation for p in parts], pa.int64()), pa.array([p.number for p in parts], pa.int32()),
                pa.array(texts), pa.array(ids, whole), pa.array(starts, places), pa.array(ends, places),
                pa.array(loss, pa.list_(pa.bool_())),
            ],
            names=["key", "part", "text", "ids", "starts", "ends", "loss"],
        )

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ready, room, part = shared.value, [], part_chars, None
        for batch in batches:
            for conversation, who, said in zip(*(batch.column(n).to_pylist() for n in ("key", "role", "text"))):
                if part is None or part.conversation != conversation or part.size >= part_chars:
                    if part:
                        ready.append(part)
                        room -= part.size
                    if room <= 0 or len(ready) >= 256:
                        yield encoded(ready, made)
                        ready, room = [], part_chars
                    same = part is not None and part.conversation == conversation
                    part = Part(conversation, part.number + 1 if same else 0)
                part.add(who, said, who in roles)
        if part:
            yield encoded([*ready, part], made)

    rows = turns.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").drop("turn")
    kinds = "key long, part int, text string, ids array<int>, starts array<long>, ends array<long>, loss array<boolean>"
    return rows.mapInArrow(render, kinds).withColumnRenamed("key", key)


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> Iterator[str]:
    """The unescaped runs of text under the loss mask, in order."""
    lo, hi = starts[loss], ends[loss]
    if not len(lo):
        return
    # tokens of one character overlap, tokens of one run touch, and between runs there is a mark
    new = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1]) + 1
    for a, b in zip([0, *new], [*new, len(lo)]):
        yield unescape(text[lo[a] : hi[b - 1]])


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what :func:`format_chats` made, read from its texts, tokens and masks alone.

    (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one row per conversation.
    It relies on a conversation's parts following one another and so adds no shuffle.
    """

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("key", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
            + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        open_key, state = None, None

        def closed() -> list:
            turns, said, chars, learned, size = state
            return [open_key, turns, said.hexdigest(), chars, learned.hexdigest(), size]

        for batch in batches:
            done = []
            keys, numbers, texts = (batch.column(n).to_pylist() for n in ("key", "part", "text"))
            lists = [batch.column(n) for n in ("starts", "ends", "loss")]
            for row, (conversation, number, text) in enumerate(zip(keys, numbers, texts)):
                # a row's lists at a time, as arrays: numbers of Python take ten times the room
                starts, ends, loss = (x[row].values.to_numpy(zero_copy_only=False) for x in lists)
                if number == 0:
                    if state:
                        done.append(closed())
                    open_key, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in TURN.findall(text):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for learned in masked_texts(text, starts, ends, loss):
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done) if done else [[]] * 6, schema)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(closed(), schema)], schema=schema)

    kinds = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = formatted.select(F.col(f"`{key}`").alias("key"), "part", "text", "starts", "ends", "loss")
    return read.mapInArrow(digests, kinds).withColumnRenamed("key", key)
