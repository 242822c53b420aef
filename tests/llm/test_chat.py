"""Rendering, escaping and masks, by round trips and by digests of the input."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wakeline.llm import chat, packing

SAID = ["", None, "plain", chat.PROBE, "<|endoftext|>", "<\\|im_end|> <\\\\|x|>", "ends <", "|begins", "\\|", "\n\nlines\n", " 😀 日本語 é", "<|im_sep|><|im_start|>", "<<<|||\\\\", "x" * 3000]


@given(st.text(alphabet="<|\\ax>im_end start\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|im_sep|>"]), st.text(alphabet="<|\\ab 😀é\n.", max_size=12)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_mask_covers_the_assistant_exactly(turns):
    tool = chat.encoder(packing.tokenizer_path())
    text, spans, trained = chat.render(turns)
    ids, offsets = tool.encode(text)
    mask = chat.loss_mask(spans, trained, offsets)
    said = "".join(t for r, t in turns if r == "assistant")
    assert chat.trained_text(tool, ids.tolist(), mask.tolist()) == said
    inside = {k for a, b in spans[trained].tolist() for k in range(a, b)}
    covered = {k for (a, b), m in zip(offsets.tolist(), mask.tolist(), strict=True) if m for k in range(a, b)}
    assert covered == inside
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat.TURN.findall(text)] == turns


def by_hand(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        said = "".join(t for *_, r, t in turns if r == "assistant")
        size = sum(32 + len(chat.escape(r)) + len(chat.escape(t)) for *_, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size)
    return out


def table():
    pick = random.Random(3)
    rows = [(c, t, pick.choice(["user", "assistant", "system", None, "Assistant"]), pick.choice(SAID)) for c in range(40) for t in range(pick.randint(1, 6))]
    rows += [(7, t, "assistant", pick.choice(SAID)) for t in range(400)]  # a conversation with most of all rows
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, None, None, None), (5, 0, "user", "same"), (5, 0, "user", "same")]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("part_chars", [1 << 20, 5000, 1])
def test_conversations_in_parts(spark, part_chars):
    rows = table()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "whole", "ids", "loss")})
    parts = chat.format_conversations(df.repartition(5), part_chars=part_chars)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(parts).collect()}
    assert got == by_hand(rows)


def test_parts_have_the_tokens_of_the_whole(spark):
    df = spark.createDataFrame([r for r in table() if r[0] == 7], "conv_id long, turn long, role string, text string")
    tool = chat.encoder(packing.tokenizer_path())
    found = sorted(chat.format_conversations(df, part_chars=2000).collect(), key=lambda r: r.part)
    whole = "".join(r.formatted for r in found)
    assert len(found) > 5 and tool.encode(whole)[0].tolist() == [i for r in found for i in r.ids]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(df)).collect() == []
