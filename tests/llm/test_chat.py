import hashlib
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from pagesift.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def back(spark, data, extra=False):
    frame = spark.createDataFrame(data, SCHEMA)
    if extra:
        frame = frame.withColumns({"turns": F.lit(1), "segments": F.lit("x"), "formatted": F.lit(None)})
    return {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}


def test_any_text_is_restored(spark):
    rng = random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "\\", "<", "[", ">", "]",
             "/", "SYS", "s", "$1", "\n", "é", "😀", "a b"]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
    data = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", text()]), text()) for c in range(300) for t in range(rng.randint(1, 6))]
    got = back(spark, data)
    for conv, found in got.items():
        own = [(r, x) for c, _, r, x in data if c == conv]
        assert [(t.role, t.text) for t in found.turns] == own
        assert found.loss_text == "".join(x for r, x in own if r == "assistant")


def test_order_nulls_and_repeats(spark):
    data = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, None, None, None), (2, 1, "user", "q"), (None, 1, "user", "x"),
            (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "tie")]
    got = back(spark, data, extra=True)
    turns = {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()}
    assert turns == {
        1: [("user", "a"), ("assistant", "b")],
        2: [("", ""), ("user", "q")],
        None: [("user", "x")],
        3: [("assistant", "tie"), ("user", "same"), ("user", "same")],
    }
    assert {c: (r.valid, r.complete) for c, r in got.items()} == {1: (True, True), 2: (False, False), None: (True, False), 3: (False, False)}
    assert back(spark, []) == {}


def test_long_text(spark):
    text = "</s>[INST]" * 20_000
    got = back(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])[1]
    assert got.loss_text == text and got.formatted_chars == 2 * 240_000 + 20


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(other_open="<</SYS>>")
    with pytest.raises(ValueError):
        chat.Template(turns={"user": chat.Turn("<u>", "u>x")})


def test_query_against_plain_python(spark):
    from pagesift.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = []
    for conv in {d[0] for d in data}:
        own = sorted(d for d in data if d[0] == conv)
        loss = "".join(d[3] for d in own if d[2] == "assistant")
        digest = hashlib.sha256("".join(f"{d[2]}\n{d[3]}\n" for d in own).encode()).hexdigest()
        want.append((conv, len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    found = QUERIES["op4_chat"](spark, sf)
    assert rows(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)
    assert "Python" not in found._jdf.queryExecution().toString()
