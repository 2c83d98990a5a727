"""Event logs folded, rendered and read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doccensus.llm import chat

SCHEMA = "conv_id long, turn long, seq long, event string, role string, text string"


def rows(frame):
    return sorted((r["conv_id"] or 0, r["turn"] if r["turn"] is not None else -1, r["position"], r["role"], r["text"]) for r in frame.collect())


def test_fold(spark):
    log = spark.createDataFrame([
        (1, 0, 0, "message", "user", "hello"), (1, 0, 5, "edit", None, "hello there"),
        (1, 1, 1, "message", "assistant", "a"), (1, 1, 3, "delta", None, "c"), (1, 1, 2, "delta", None, "b"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 6, "delta", None, "x"), (1, 1, 7, "delta", None, "y"),
        (2, 0, 1, "delta", "user", "no start"), (2, 0, 2, "delta", None, "!"), (2, 1, 1, "message", "assistant", "one"), (2, 1, 2, "message", "assistant", "two"),
    ], SCHEMA).repartition(4)
    assert rows(chat.fold_events(log)) == [
        (1, 0, 0, "user", "hello there"), (1, 1, 0, "assistant", "xy"), (2, 0, 0, "user", "no start!"), (2, 1, 0, "assistant", "one"), (2, 1, 1, "assistant", "two"),
    ]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=list("<|>/s[INST]\\ a\né"), max_size=25), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in frame.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|text|>x", "<\\|end|>", "", None, "plain é\n\n"]
    given_ = [(k, i, "assistant" if i % 2 else ("user" if i else None), t) for k in range(3) for i, t in enumerate(texts[k:])]
    frame = spark.createDataFrame(given_, "conv_id long, turn long, role string, text string").repartition(4)
    made = chat.format_conversations(chat.as_events(frame))
    for r in made.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        mine = [(role or "", text or "") for k, _, role, text in given_ if k == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")
        assert len(r["loss_spans"]) == sum(role == "assistant" for role, _ in mine)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_streamed_log_folds_to_its_messages(spark, piece):
    texts = ["", None, "x" * 64, "é😀 [INST]\n" * 30, "short", "</s>"]
    given_ = [(k, i % 4 if k else None, "assistant" if i % 2 else None, t) for k in range(9) for i, t in enumerate(texts)] + [(None, 0, "user", "a")] * 2
    frame = spark.createDataFrame(given_, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.streamed_events(frame, piece)
    assert {r["event"] for r in log.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    mixed = log.orderBy(F.xxhash64("text", "seq"))
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold_events(mixed).orderBy("conv_id", "turn", "position").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    assert got == sorted([(c, t, role or "", text or "") for c, t, role, text in given_], key=key)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chat.as_events(empty)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, 1), (1, 0, "user", "a", 2), (1, 0, "user", "a", 2), (1, None, "user", "b", 3)], "conv_id long, turn long, role string, text string, position int")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(chat.as_events(odd)).collect()}
    one = "<|turn|>user<|text|>{}<|end|>\n"
    assert got == {None: "<|turn|><|text|><|end|>\n", 1: one.format("b") + one.format("a") * 2}


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query_reads_back(spark, sf_dir):
    from doccensus.llm.registry import QUERIES

    hard = "</s>[INST] ok [/INST]"
    row = QUERIES["op8_chat"](spark, sf_dir).filter("conv_id = -7").first()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{hard}\nassistant\n{hard}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(hard), hashlib.sha256(hard.encode()).hexdigest())
