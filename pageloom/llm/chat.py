"""Chat formatting at the level of tokens.

A turn's segments (a role's name, a text) are encoded each on its own by a byte-level vocabulary without special
tokens; control marks are ids above that vocabulary, spliced between the segments, so no text can produce one. The
places of segments, and the loss mask, are prefix sums of segment lengths. Where the result is written as a string,
control strings inside a text are escaped: one backslash more after their bracket, which is undone in reading.

A conversation reads `<s>`, then its turns: `[INST]text[/INST]` of a user, `text</s>` of the assistant, and
`[ROLE]name[/ROLE]text</s>` of any other role.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_offsets

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_BOS, _EOS, _USER, _USER_END, _ROLE, _ROLE_END = range(len(CONTROLS))
_BARE = "|".join(re.escape(c[1:]) for c in CONTROLS)
_LIVE = re.compile(rf"([<\[])(\\*)(?={_BARE})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_BARE})")
_LONG = 1 << 16  # code points: longer texts reach the tokenizer in stretches
_BREAK = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")  # U+001C-U+001F are no white space to the tokenizer
_FLUSH = 1 << 20  # ids in a batch
_CHUNK = 1 << 12  # turns of one conversation that are counted together


def escape(text: str) -> str:
    """The text without control strings: `</s>` becomes `<\\/s>`, and `<\\/s>` becomes `<\\\\/s>`."""
    return _LIVE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class Segments:
    """The vocabulary of one file of ranks, with the control marks after its last id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first_control = max(ranks.values()) + 1

    def encode(self, text: str) -> list[int]:
        """Ids of the escaped text. A very long one is cut before white space that follows something else, where the vocabulary's pattern splits anyway, so its ids are those of the whole."""
        text = escape(text)
        if len(text) <= _LONG:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            found = _BREAK.search(text, at + _LONG)
            to = found.start() if found else len(text)
            out += self.encoding.encode_ordinary(text[at:to])
            at = to
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The escaped text."""
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")

    def turn(self, ids: np.ndarray) -> tuple[str, str, int]:
        """(role, text, code points that it takes as a string) of the ids of one turn, with or without `<s>` before it."""
        marks = ids.astype(np.int64) - self.first_control
        chars = sum(len(CONTROLS[m]) for m in marks[marks >= 0].tolist())
        if marks[0] == _BOS:
            ids, marks = ids[1:], marks[1:]
        if marks[0] == _USER:
            name, text = "user", self.decode(ids[1:-1])
        elif marks[0] == _ROLE:
            k = int(np.flatnonzero(marks == _ROLE_END)[0])
            name, text = self.decode(ids[1:k]), self.decode(ids[k + 1 : -1])
            chars += len(name)
        else:
            name, text = "assistant", self.decode(ids[:-1])
        return unescape(name), unescape(text), chars + len(text)


_KEPT: dict[str, Segments] = {}


def segments(path: str) -> Segments:
    """This worker's vocabulary, kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = Segments(path)
    return _KEPT[path]


def turn_layout(role: str, text: str) -> list[tuple[int | str, bool]]:
    """A turn as controls and texts, each with whether loss is taken on it."""
    if role == "user":
        return [(_USER, False), (text, False), (_USER_END, False)]
    if role == "assistant":
        return [(text, True), (_EOS, False)]
    return [(_ROLE, False), (role, False), (_ROLE_END, False), (text, False), (_EOS, False)]


def format_conversations(turns: DataFrame, vocabulary: str) -> DataFrame:
    """One row per turn: conv_id, turn, start, ids, loss.

    ids are the turn's tokens, start is how many tokens of the conversation precede them and loss has a bit for
    each token; a conversation is its turns' ids in the order of start. Turns are ordered by turn (null first), then
    role, then text; repeated rows are turns of their own. A null role or text is empty; null conv_ids are one
    conversation; other columns are ignored; an empty table gives no rows. No conversation is gathered: turns are
    encoded where they lie, and only their lengths are summed, in stretches of a conversation.
    """

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = segments(vocabulary)
        for b in it:
            flat: list[int] = []
            length, lossy, of_turn, done = [], [], [], 0
            for k, (role, text) in enumerate(zip(b.column("role"), b.column("text"), strict=True)):
                layout = turn_layout(role.as_py(), text.as_py())
                for what, loss in layout:
                    ids = [vocab.first_control + what] if isinstance(what, int) else vocab.encode(what)
                    flat += ids
                    length.append(len(ids))
                    lossy.append(loss)
                of_turn.append(len(layout))
                if len(flat) > _FLUSH or k + 1 == b.num_rows:
                    yield assemble(b.slice(done, len(of_turn)), flat, length, lossy, of_turn)
                    flat, length, lossy, of_turn, done = [], [], [], [], k + 1

    def assemble(b: pa.RecordBatch, flat: list[int], length: list[int], lossy: list[bool], of_turn: list[int]) -> pa.RecordBatch:
        """By prefix sums: where segments begin, where loss is switched on and off, where turns end."""
        end = np.cumsum(np.array([0, *length], np.int64))
        switch = np.zeros(len(flat) + 1, np.int64)
        on = np.array(lossy, bool)
        np.add.at(switch, end[:-1][on], 1)
        np.add.at(switch, end[1:][on], -1)
        mask = np.cumsum(switch)[:-1].astype(np.int8)
        turn_end = pa.array(end[np.cumsum(np.array([0, *of_turn], np.int64))].astype(np.int32))
        ids, loss = (pa.ListArray.from_arrays(turn_end, pa.array(x)) for x in (np.array(flat, np.int32), mask))
        return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("tie"), ids, loss], names=["conv_id", "turn", "tie", "ids", "loss"])

    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.concat(role, F.lit("\n"), F.sha2(text, 256)).alias("tie"))
    encoded = rows.mapInArrow(encode, "conv_id long, turn long, tie string, ids array<int>, loss array<tinyint>")
    first_control = segments(vocabulary).first_control
    placed = running_offsets(encoded, ["conv_id"], [F.col("turn"), F.col("tie")], F.coalesce(F.floor(F.col("turn") / _CHUNK), F.lit(-(1 << 62))), F.size("ids"), "start")
    first = F.col("start") == 0  # every turn has a token, so only the first one of a conversation begins at 0
    return placed.select(
        "conv_id",
        "turn",
        F.when(first, 0).otherwise(F.col("start") + 1).cast("long").alias("start"),
        F.when(first, F.concat(F.array(F.lit(first_control + _BOS)), "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(first, F.concat(F.array(F.lit(0).cast("tinyint")), "loss")).otherwise(F.col("loss")).alias("loss"),
    )


class _Reader:
    """Reads one conversation back from its ids, piece by piece: what it holds doesn't grow with the turns."""

    def __init__(self, vocab: Segments):
        self.vocab, self.turns, self.loss = vocab, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, ids: np.ndarray, loss: np.ndarray) -> None:
        """The ids of the next turn."""
        role, text, chars = self.vocab.turn(ids)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        self.chars += chars
        if loss.any():
            edge = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                t = unescape(self.vocab.decode(ids[a:b]))
                self.loss.update(t.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(t)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """What the tokens of format_conversations say: a row per conversation with the digests of its turns and of its text under the loss mask.

    formatted_chars: code points of the conversation written as a string. A task passes along its conversations in
    order, however long one is, and holds one turn at a time.
    """

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, now, reader = segments(vocabulary), None, None
        out: list[tuple] = []

        def row() -> tuple:
            return (now[0], reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in it:
            ids, loss = b.column("ids"), b.column("loss")
            at, flat, mask = ids.offsets.to_numpy(), ids.values.to_numpy(), loss.values.to_numpy()
            for k, conv in enumerate(b.column("conv_id").to_pylist()):
                if now != (conv,):
                    if now:
                        out.append(row())
                    now, reader = (conv,), _Reader(vocab)
                reader.add(flat[at[k] : at[k + 1]], mask[at[k] : at[k + 1]])
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if now:
            out.append(row())
        if out:
            yield batch(out)

    return formatted.select("conv_id", "start", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "start").select("conv_id", "ids", "loss").mapInArrow(read, READ)
