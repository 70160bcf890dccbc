"""Chat formatting: reversible escapes, spans by comparison, templates that rewrite history."""

from __future__ import annotations

import hashlib
import random

from spanwise.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, spans string"


def test_escapes_are_reversible():
    rng = random.Random(1)
    pool = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "SYS]", "\n", "a", "<s>", "</s>"]
    for _ in range(3000):
        turns = [("".join(rng.choices(pool, k=rng.randint(0, 5))), "".join(rng.choices(pool, k=rng.randint(0, 9)))) for _ in range(3)]
        out = chat.marked(turns)
        assert chat.parse_marked(out) == turns
        assert out.count("</s>") == 3 and "[INST]" not in out


def test_spans_hold_the_texts():
    turns = [("user", "a</s>"), ("assistant", ""), ("tool", "x" * 1000), ("assistant", "é🙂")]
    out, spans, where, _ = chat.locate(turns, chat.marked, chat.marked_opening)
    assert where is None and [chat.unescape(out[s[2]:s[3]]) for s in spans] == [t for _, t in turns]
    assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == len(out)


def test_a_template_that_rewrites_history():
    def render(turns):  # only the last assistant turn keeps its notes
        return "".join(f"{r}:{t if n == len(turns) - 1 else t.split('#')[0]};" for n, (r, t) in enumerate(turns))

    turns = [("user", "hi"), ("assistant", "yes#note"), ("user", "more")]
    out, spans, where, when = chat.locate(turns, render, lambda role: f"{role}:")
    assert out == "user:hi;assistant:yes;user:more;" and (where, when) == (out.index("yes") + 3, 2)
    assert spans[0] == (0, 8, 5, 7) and spans[1] is None and spans[2] is None


def test_query_on_edges(spark, tmp_path):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 0, None, "</s>"), (2, 0, None, "</s>"),
            (None, 5, "assistant", "<s>x"), (3, None, "assistant", "n" * 100_000)]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    turns = {-1: [("user", said), ("assistant", said)], 1: [("user", "a"), ("assistant", "b"), ("assistant", "")],
             2: [("", "</s>")] * 2, None: [("assistant", "<s>x")], 3: [("assistant", "n" * 100_000)]}

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = {}
    for conv, of in turns.items():
        loss = "".join(t for r, t in of if r == "assistant")
        want[conv] = (len(of), sha("".join(f"{r}\n{t}\n" for r, t in of)), len(loss), sha(loss), len(chat.marked(of)))
    assert {r[0]: tuple(r)[1:] for r in registry.op1_chat(spark, str(tmp_path)).collect()} == want


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
