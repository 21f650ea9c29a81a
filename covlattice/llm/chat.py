"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
spans of its assistant turns, sorted as they stand, are met with the spans of
the tokens by binary search.  What a token has in common with an assistant turn
is under the loss; control strings, other turns and the turn's own end are not.

Template: ``[INST] role\\ntext [/INST]`` for every other role, ``text</s>`` for
the assistant.  A backslash breaks each control string inside a text or role
(``[INST]`` becomes ``[\\INST]``) and doubles itself, so texts come back as they
were.  Control strings are special tokens of the encoder: it cuts there before
anything else, so no token crosses one, and a conversation that is rendered in
several parts, each from a turn's start on, has the ids of the whole one.

Scale: rows are shuffled by conversation and block of ``TURNS`` turn numbers and
streamed in order, so a conversation with a third of all rows is spread by
blocks; a block over ``PART_CHARS`` characters is cut into further parts.
:func:`read_conversations` reads a part's turns and its text under the mask
back, and only conversations of several parts send texts on to be hashed as one
stream.

Defined results: rows are turns in the order of (turn, role, text), nulls first;
repeated rows are turns of their own; null texts and roles are empty; a null id
is an id like others; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covlattice.llm.common import small

#: Turn numbers of a block, and characters after which a part of a block ends.
TURNS, PART_CHARS = 256, 1 << 20
#: The role whose texts are learned.
LEARNED = "assistant"
#: Control strings of the template.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"

_FORMATTED = "part long, several boolean, text string, ids array<int>, starts array<int>, ends array<int>, loss_from array<int>, loss_to array<int>"


class Template(NamedTuple):
    """Renders turns and reads them back; ``controls`` are all strings that mean something to the encoder."""

    controls: tuple[str, ...] = (OPEN, CLOSE, END)

    def escape(self, text: str, also: str = "") -> str:
        found = "|".join(map(re.escape, (*self.controls, *also)))
        return re.sub(rf"\\|{found}", lambda m: m[0][0] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
        """The text of (role, text) turns, and the sorted (start, end) spans of what is learned."""
        out, spans, at = [], [], 0
        for role, text in turns:
            own = self.escape(text)
            if role == LEARNED:
                spans.append((at, at + len(own)))
                own += END
            else:
                own = f"{OPEN} {self.escape(role, chr(10))}\n{own} {CLOSE}"
            out.append(own)
            at += len(own)
        return "".join(out), np.array(spans, np.int64).reshape(-1, 2)

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a rendered text."""
        o, c, e = map(re.escape, (OPEN, CLOSE, END))
        turns = re.finditer(rf"{o} ((?:[^\\\n]|\\.)*)\n(.*?) {c}|(.*?){e}", text, re.DOTALL)
        return [
            (LEARNED, self.unescape(m[3])) if m[3] is not None else (self.unescape(m[1]), self.unescape(m[2])) for m in turns
        ]


class ChatEncoder:
    """A tokenizer file's encoder with the template's control strings as special tokens."""

    def __init__(self, vocabulary: str):
        from tokenizers import AddedToken, Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        own = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.template = Template((OPEN, CLOSE, END, *own))
        self.lib.add_special_tokens([AddedToken(t, normalized=False) for t in (OPEN, CLOSE, END)])
        self.lib.no_truncation()
        self.lib.no_padding()

    def encode(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Rendered text, ids, (start, end) of each token and what of that is learned, as another (start, end)."""
        text, spans = self.template.render(turns)
        found = self.lib.encode(text, add_special_tokens=False)
        tokens = np.array(found.offsets, np.int64).reshape(-1, 2)
        return text, np.array(found.ids, np.int64), tokens, aligned(tokens, spans)


def aligned(tokens: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Per token, the (start, end) that it shares with a span; both sorted, spans apart from each other; empty at the token's start if none."""
    shared = np.stack([tokens[:, 0], tokens[:, 0]], 1)
    if len(spans):
        k = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")  # the first span that ends after the token starts
        near = spans[np.minimum(k, len(spans) - 1)]
        low, high = np.maximum(tokens[:, 0], near[:, 0]), np.minimum(tokens[:, 1], near[:, 1])
        met = (k < len(spans)) & (low < high)
        shared[met] = np.stack([low, high], 1)[met]
    return shared


def masked_text(text: str, loss_from: np.ndarray, loss_to: np.ndarray) -> str:
    """What lies under the mask, once each: tokens that are parts of one character overlap in it."""
    reach = np.maximum.accumulate(np.r_[0, loss_to])[:-1] if len(loss_to) else loss_to
    low = np.maximum(loss_from, reach)
    return "".join([text[a:b] for a, b in zip(low.tolist(), loss_to.tolist()) if a < b])


_ENCODERS: dict[str, ChatEncoder] = {}


def chat_encoder(vocabulary: str) -> ChatEncoder:
    """The encoder of a file, made once in each worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChatEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _ints(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, int)]).astype(np.int32)))


def format_conversations(
    turns: DataFrame, vocabulary: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_turns: int = TURNS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """``conv_id``, part, several, text, ids, starts, ends, loss_from, loss_to: a row per part of a conversation.

    Parts of a conversation follow each other in the order of ``part``;
    ``several`` is false where there is one.  The token arrays are character
    offsets in the part's text: of each token, and of what of it is learned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind = chat_encoder(vocabulary), None

        def made(key: tuple, number: int, several: bool, held: list[tuple[str, str]]) -> pa.RecordBatch:
            shown, ids, tokens, loss = enc.encode(held)
            arrays = [_ints([x]) for x in (ids, tokens[:, 0], tokens[:, 1], loss[:, 0], loss[:, 1])]
            # parts of a block are fewer than 2^20, so blocks stay in their order
            head = [pa.array([key[0]], kind), pa.array([key[1] * (1 << 20) + number], pa.int64()), pa.array([several])]
            return pa.RecordBatch.from_arrays(
                [*head, pa.array([shown], pa.string()), *arrays],
                names=["conv_id", "part", "several", "text", "ids", "starts", "ends", "loss_from", "loss_to"],
            )

        key, number, held, chars, whole = None, 0, [], 0, True
        for batch in batches:
            kind = batch.column("conv_id").type
            for c, b, many, r, t in _rows([batch], ["conv_id", "block", "many", "role", "text"]):
                if held and (c, b) != key:
                    yield made(key, number, not whole or number > 0, held)
                    number, held, chars = 0, [], 0
                elif held and chars >= part_chars:
                    yield made(key, number, True, held)
                    number, held, chars = number + 1, [], 0
                key, whole = (c, b), not many
                held.append((r, t))
                chars += len(t)
        if held:
            yield made(key, number, not whole or number > 0, held)

    chosen = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        # a null turn comes before all blocks
        F.coalesce(F.floor(F.col(f"`{turn}`") / block_turns), F.lit(-(1 << 40))).alias("block"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    ends = chosen.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    long = ends.where("low < high").select(F.col("conv_id").alias("long_id"), F.lit(True).alias("long"))
    marked = chosen.join(small(long), F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
    dealt = marked.select("conv_id", "turn", "block", F.col("long").isNotNull().alias("many"), "role", "text")
    ordered = dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {chosen.schema['conv_id'].dataType.simpleString()}, {_FORMATTED}")


def read_conversations(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, part, several, turns (role, text), learned (the text under the mask, unescaped), n_chars of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = chat_encoder(vocabulary).template
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                low, high = (batch.column(n)[i].values.to_numpy() for n in ("loss_from", "loss_to"))
                turns = [{"role": r, "text": t} for r, t in template.parse(text)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).slice(i, 1) for n in ("conv_id", "part", "several")),
                        pa.array([turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                        pa.array([template.unescape(masked_text(text, low, high))], pa.string()),
                        pa.array([len(text)], pa.int64()),
                    ],
                    names=["conv_id", "part", "several", "turns", "learned", "n_chars"],
                )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        run, f"conv_id {kind}, part long, several boolean, turns array<struct<role string, text string>>, learned string, n_chars long"
    )


def conversation_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of whole conversations.

    A part that is a conversation is hashed where it is; of the others the texts
    are sent on, and a task streams a conversation's parts, one at a time.
    """
    kind = read.schema["conv_id"].dataType.simpleString()

    def _said(turns: list[dict]) -> bytes:
        return "".join([f"{t['role']}\n{t['text']}\n" for t in turns]).encode()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "part", "several", "turns", "learned", "n_chars"]
        for batch in batches:
            out = []
            for _, _, several, turns, learned, n in _rows([batch], names):
                said, own = _said(turns), learned.encode()
                digests = (None, None) if several else (hashlib.sha256(said).hexdigest(), hashlib.sha256(own).hexdigest())
                out.append((len(turns), digests[0], len(learned), digests[1], n, said if several else None, own if several else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("part"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                names=["conv_id", "part", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "said", "own"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        type_, held = None, None

        def made(x: list) -> tuple:
            return (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5])

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            type_, rows = batch.column("conv_id").type, []
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "said", "own"]
            for c, n, turns, chars, loss, total, said, own in _rows([batch], names):
                if held and (said is None or c != held[0]):
                    rows.append(made(held))
                    held = None
                if said is None:
                    rows.append((c, n, turns, chars, loss, total))
                    continue
                held = held or [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1], held[3], held[5] = held[1] + n, held[3] + chars, held[5] + total
                held[2].update(said)
                held[4].update(own)
            if rows:
                yield table(rows)
        if held:
            yield table([made(held)])

    result = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    parts = read.mapInArrow(
        shorten, result.replace("conv_id " + kind, f"conv_id {kind}, part long") + ", said binary, own binary"
    )
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(merge, result)
