import hashlib
import random

import pytest

from sketchloom.llm import chat


def case():
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "é", "\n", " ", "<\\/s>", "[\\\\INST]", "$1", "a"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "tool"]) if c % 3 else ("user", "assistant")[t % 2], text()))
    return rows + [(100, 0, "user", None), (100, 1, "assistant", None), (101, None, "user", "x"), (101, 0, None, "y"), (None, 0, "user", "</s>"), (None, 1, "assistant", "z"), (102, 0, "<s>", "odd [/INST] role"), (103, 0, "user", "same"), (103, 0, "user", "same"), (104, 0, "assistant", "long </s> " * 20_000)]


def test_round_trip(spark):
    rows = case()
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(4)
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_chats(made).collect()}
    sums = {r["conv_id"]: r for r in chat.chat_digest(chat.read_chats(made)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == turns
        lost = [t for r, t in turns if r == "assistant"]
        assert got[c]["loss_texts"] == lost
        assert got[c]["formatted"].count("</s>") == len(turns)
        assert sums[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert sums[c]["loss_sha256"] == hashlib.sha256("".join(lost).encode()).hexdigest() and sums[c]["loss_chars"] == len("".join(lost))
        state, bad = "start", None
        for k, (r, _) in enumerate(turns):
            if bad is None and r not in chat.DEFAULT_TEMPLATE.transitions.get(state, ()):
                bad = k
            state = r
        assert got[c]["bad_turn"] == bad and got[c]["valid"] == (bad is None and state == "assistant")


def test_escaped_texts_hold_no_control_string(spark):
    made = chat.format_chats(spark.createDataFrame(case(), "conv_id long, turn long, role string, text string"))
    for r in made.collect():
        for k, s in enumerate(r["segments"]):
            if k % 3 == 1:
                assert not any(x in s["text"] for x in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_plan_has_no_python_and_empty_tables_pass(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.chat_digest(chat.read_chats(chat.format_chats(df)))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_other_templates_escape_their_own_marks(spark):
    rng = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "\n", "\\", "<", "<\\|im_end|>", "|im_end|>", "</s>", "there"]
    rows = [(c, t, rng.choice(["user", "a\n\nb"]), "".join(rng.choice(bits) for _ in range(9))) for c in range(40) for t in range(3)]
    rows += [(99, 0, "user", "hi <|im_end|> there"), (99, 1, "assistant", "<|im_end|>")]
    template = chat.ChatTemplate(open="<|im_start|>", close="<|sep|>", end="<|im_end|>", reserved=("<|endoftext|>",))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_chats(chat.format_chats(df, template), template).collect():
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(o, x) for c, _, o, x in rows if c == r["conv_id"]]
        assert r["formatted"].count("<|im_end|>") == r["n_turns"] and "<|endoftext|>" not in r["formatted"]


@pytest.mark.parametrize("marks", [{"end": "x"}, {"end": "aba"}, {"open": "<a", "close": "a>"}, {"end": "</s>[INST]"}, {"close": "a\\b"}])
def test_marks_that_texts_could_form_are_refused(marks):
    with pytest.raises(ValueError):
        chat.ChatTemplate(**marks)
