import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactlake.llm import bpe, chat
from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path

PATH = vocabulary_path(BYTE_BPE)
PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "INST]", "é", " ", "ok", "\n", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES), max_size=6))
def test_turns_come_back_from_ids(turns):
    v = bpe.load(PATH)
    ids, mask, characters = chat.assemble(turns, v)
    got, learned = chat.parse(ids, mask, v)
    assert got == turns and learned == [t for r, t in turns if r == "assistant"]
    assert len(ids) == len(mask) and not mask[ids >= v.size].any()
    plain = "".join(chat.CONTROLS[i - v.size] if i >= v.size else "" for i in ids.tolist())
    assert characters == len(plain) + sum(len(chat.escape(t)) for _, t in turns) + sum(len(r) for r, _ in turns if r not in chat.AROUND)


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_TEXT", part)
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t} of {c} </s> \\ [INST] " * (1 + t)) for c in range(6) for t in range(9)]
    rows += [(1, 3, "assistant", "again"), (1, 3, "assistant", "again"), (2, None, None, None), (None, 0, "tool", ""), (None, 1, "assistant", "x" * 9000)]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, c string")
    formatted = chat.format_conversations(df, PATH)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted, PATH).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df, PATH), PATH).collect() == []


def test_reserved_ids_are_beyond_the_vocabulary():
    v = bpe.load(PATH)
    assert min(chat.control_ids(v).values()) == v.size > np.max(v.merged)
