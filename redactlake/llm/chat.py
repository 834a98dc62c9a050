"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums.

A turn becomes the reserved ids of its role around the ids of its text. Texts are escaped first, so
no control string of the template can be read out of one; a reader that knows the template undoes
it. Reserved ids lie beyond the vocabulary, so no text can encode to one. The loss mask marks
exactly the tokens of assistant texts.

Output is one row per part of a conversation: a part is some whole turns, of about ``PART_TEXT``
characters, so a very long conversation needs no more memory than a short one.

Turns are ordered by ``turn`` (null first), then role and text. Null texts and roles count as empty;
rows without a conversation id form one conversation. Repeated rows are repeated turns. An empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

PART_TEXT = 1 << 20

#: The control strings of the template, in the order of their reserved ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
#: The controls around a text, by role; any other role is named between [ROLE] and [/ROLE].
AROUND = {"user": (["<s>", "[INST]"], ["[/INST]"]), "assistant": ([], ["</s>"]), "system": (["<<SYS>>"], ["<</SYS>>"])}
LEARNED_ROLE = "assistant"

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    r"""Double every backslash, and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    r"""Undo ``escape``: two backslashes are one, a single one goes."""
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def control_ids(vocabulary: bpe.Bpe) -> dict[str, int]:
    return {c: vocabulary.size + i for i, c in enumerate(CONTROLS)}


def assemble(turns: list[tuple[str, str]], vocabulary: bpe.Bpe) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, loss mask, characters of the formatted text) of whole turns (role, text)."""
    reserved = control_ids(vocabulary)
    texts: list[str] = []
    plan: list[tuple[int, bool]] = []  # (text number, or -1 - reserved id; whether it is learned)
    characters = 0
    for role, text in turns:
        before, after = AROUND.get(role, (None, None))
        if before is None:
            plan.append((-1 - reserved["[ROLE]"], False))
            plan.append((len(texts), False))
            texts.append(escape(role))
            before, after = ["[/ROLE]"], ["</s>"]
            characters += len("[ROLE]")
        plan += [(-1 - reserved[c], False) for c in before]
        plan.append((len(texts), role == LEARNED_ROLE))
        texts.append(escape(text))
        plan += [(-1 - reserved[c], False) for c in after]
        characters += sum(map(len, [*before, *after]))
    characters += sum(map(len, texts))
    encoded = vocabulary.encode(texts)
    segments = [encoded[n] if n >= 0 else int(-1 - n).to_bytes(4, "little") for n, _ in plan]
    ids = np.frombuffer(b"".join(segments), "<u4")
    ends = np.cumsum([len(s) // 4 for s in segments], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    learned = np.array([x for _, x in plan], bool)
    # +1 where a learned segment begins, -1 where it ends; the prefix sum is the mask.
    step = np.bincount(starts[learned], minlength=len(ids) + 1) - np.bincount(ends[learned], minlength=len(ids) + 1)
    return ids, np.cumsum(step)[: len(ids)].astype(bool), characters


def format_conversations(
    rows: DataFrame, vocabulary: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, part, token_ids, loss_mask, formatted_chars).

    ``token_ids`` is little-endian unsigned 32-bit integers, ``loss_mask`` one bit per token, packed.
    """
    kind = rows.schema[conversation].dataType.simpleString()
    turns = rows.select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    ordered = turns.repartition("c").sortWithinPartitions("c", "t", "r", "x").drop("t")

    def run(batches):
        v = bpe.load(vocabulary)
        held: list[tuple[str, str]] = []
        current, part, size, started = None, 0, 0, False
        kind_of = None

        def flush():
            ids, mask, characters = assemble(held, v)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current], kind_of),
                    pa.array([part], pa.int64()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([np.packbits(mask).tobytes()], pa.binary()),
                    pa.array([characters], pa.int64()),
                ],
                [conversation, "part", "token_ids", "loss_mask", "formatted_chars"],
            )

        for batch in batches:
            kind_of = batch.column(0).type
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if started and (c != current or size > PART_TEXT):
                    yield flush()
                    part = part + 1 if c == current else 0
                    held, size = [], 0
                current, started = c, True
                held.append((r, x))
                size += len(x)
        if started:
            yield flush()

    return ordered.mapInArrow(
        run, f"`{conversation}` {kind}, part bigint, token_ids binary, loss_mask binary, formatted_chars bigint"
    )


def parse(ids: np.ndarray, mask: np.ndarray, vocabulary: bpe.Bpe) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns (role, text) of formatted ids, and the texts under the mask, all unescaped."""
    at = np.flatnonzero(ids >= vocabulary.size)
    names = [CONTROLS[i] for i in (ids[at] - vocabulary.size).tolist()]
    text = lambda a, b: unescape(vocabulary.decode(ids[a:b].astype(np.int64)).decode("utf-8", "replace"))
    turns, learned, begin, role = [], [], 0, None
    for name, here in zip(names, at.tolist(), strict=True):
        if name == "[INST]":
            role = "user"
        elif name == "<<SYS>>":
            role = "system"
        elif name == "[/ROLE]":
            role = text(begin, here)
        elif name in ("[/INST]", "<</SYS>>", "</s>"):
            said = LEARNED_ROLE if role is None else role
            turns.append((said, text(begin, here)))
            if said == LEARNED_ROLE:
                learned.append(unescape(vocabulary.decode(ids[begin:here][mask[begin:here]].astype(np.int64)).decode("utf-8", "replace")))
            role = None
        begin = here + 1
    return turns, learned


def read_back(formatted: DataFrame, vocabulary: str, conversation: str = "conv_id") -> DataFrame:
    """Digests of what the formatted rows hold, one row per conversation, parts in order."""
    kind = formatted.schema[conversation].dataType.simpleString()
    columns = formatted.select(conversation, "part", "token_ids", "loss_mask", "formatted_chars")
    ordered = columns.repartition(conversation).sortWithinPartitions(conversation, "part")

    def run(batches):
        v = bpe.load(vocabulary)
        current, state, started, kind_of = None, None, False, None

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([current], kind_of),
                    pa.array([state["n"]], pa.int64()),
                    pa.array([state["turns"].hexdigest()], pa.string()),
                    pa.array([state["chars"]], pa.int64()),
                    pa.array([state["loss"].hexdigest()], pa.string()),
                    pa.array([state["formatted"]], pa.int64()),
                ],
                [conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        for batch in batches:
            kind_of = batch.column(0).type
            for i in range(batch.num_rows):
                c, _, ids, mask, characters = (batch.column(k)[i].as_py() for k in range(5))
                if started and c != current:
                    yield flush()
                if not started or c != current:
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                current, started = c, True
                ids = np.frombuffer(ids, "<u4")
                turns, learned = parse(ids, np.unpackbits(np.frombuffer(mask, np.uint8), count=len(ids)).astype(bool), v)
                state["n"] += len(turns)
                state["formatted"] += characters
                for role, text in turns:
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for text in learned:
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
        if started:
            yield flush()

    return ordered.mapInArrow(
        run,
        f"`{conversation}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
