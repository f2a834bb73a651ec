"""Chat formatting at the level of tokens.

A turn is  <|turn|> role <|text|> text <|end|>.  The three marks are reserved ids above the
tokenizer's vocabulary, spliced between the ids of role and text, which are encoded each by
itself; a mark can thus never arise from a text.  In the string form of the template it could,
so control strings inside texts are escaped, reversibly: an escape character is put after the
first character of each, and the escape character itself is doubled.  The loss mask covers the
ids of assistants' texts and comes from prefix sums over +1 and -1 at their borders.

Edge cases: a null role or text is empty; very long texts are encoded whole; turns of one number are ordered
by role, then text, null turns first, repeated rows count as often as they occur; a conversation of very many
turns is read by one task, turn by turn, as its digests run through it in order; rows without conv_id are one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.common import as_strings, pick, tidied
from mosaicore.llm.tokens import load

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates give a meaning, this one's first.
CONTROLS = [TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ESCAPE = "\x1b"
_FOUND = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
#: Rows that are encoded at a time.
ROWS = 512


def escape(text: str) -> str:
    """text without any control string in it."""
    text = text.replace(ESCAPE, ESCAPE + "e")
    return _FOUND.sub(lambda m: m[0][0] + ESCAPE + "c" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(ESCAPE + "([ce])", lambda m: ESCAPE if m[1] == "e" else "", text)


class Assembler:
    """Turns to ids and masks, and back."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        top = self.tokenizer.get_vocab_size()
        self.turn, self.text, self.end = top, top + 1, top + 2

    def ids(self, turns: list[tuple[str, str]]) -> list[np.ndarray]:
        """The ids of each turn."""
        flat = [escape(x) for turn in turns for x in turn]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        return [np.array([self.turn, *role, self.text, *text, self.end], np.uint32) for role, text in zip(ids[::2], ids[1::2], strict=True)]

    def mask(self, ids: np.ndarray, roles: list[str]) -> np.ndarray:
        """True for ids of assistants' texts: prefix sums over their borders."""
        step = np.zeros(len(ids) + 1, np.int64)
        starts, ends = np.flatnonzero(ids == self.text) + 1, np.flatnonzero(ids == self.end)
        learn = np.array([r == "assistant" for r in roles], bool)
        np.add.at(step, starts[learn], 1)
        np.add.at(step, ends[learn], -1)
        return np.cumsum(step[:-1]) > 0

    def decode(self, parts: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([p.tolist() for p in parts], skip_special_tokens=False)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str, str]]:
        """(role, text, text under the mask, formatted string) of each turn, from ids and mask alone."""
        a, b, c = (np.flatnonzero(ids == x).tolist() for x in (self.turn, self.text, self.end))
        learnt = np.concatenate([[0], np.cumsum(mask)])
        parts, masked = [], []
        for i, j, k in zip(a, b, c, strict=True):
            n = int(learnt[k] - learnt[i])
            whole = n == k - j - 1 == int(learnt[k] - learnt[j + 1])  # the mask covers the text and nothing else: it need not be decoded again
            parts += [ids[i + 1 : j], ids[j + 1 : k]]
            masked.append(whole)
            if not whole and n:
                parts.append(ids[i:k][mask[i:k]])
        out = iter(self.decode(parts))
        found = []
        for n, (i, k) in enumerate(zip(a, c, strict=True)):
            role, text = next(out), next(out)
            loss = text if masked[n] else next(out) if learnt[k] > learnt[i] else ""
            found.append((unescape(role), unescape(text), unescape(loss), f"{TURN}{role}{TEXT}{text}{END}"))
        return found


def assemble(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, role, text, ids and mask (bytes of 0 and 1) of every turn; a conversation is its turns' ids in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Assembler(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                turns = list(zip(as_strings(batch.column(2)), as_strings(batch.column(3)), strict=True))
                ids = own.ids(turns)
                sizes = np.cumsum([len(x) for x in ids])[:-1]
                masks = np.split(own.mask(np.concatenate(ids), [r for r, _ in turns]), sizes) if ids else []
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([m.astype(np.uint8).tobytes() for m in masks], pa.binary())], names=["conv_id", "turn", "role", "text", "ids", "mask"])

    rows = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(tidied(each), "conv_id long, turn long, role string, text string, ids binary, mask binary")


def read_back(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation, from ids and masks in the order of turns.

    A partition's conversations come sorted and are read turn by turn, so one that is very long
    needs no more memory than its longest turn.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Assembler(tokenizer)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None
        done: list[list] = []

        def close() -> None:
            if state is not None:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
                masks = [np.frombuffer(x, np.uint8) > 0 for x in batch.column(2).to_pylist()]
                read = own.read(np.concatenate(ids), np.concatenate(masks))
                for conv, (role, text, loss, formatted) in zip(batch.column(0).to_pylist(), read, strict=True):
                    if state is None or state[0] != conv:
                        close()
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                    state[5] += len(formatted)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.select("conv_id", "ids", "mask").mapInArrow(tidied(each), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
