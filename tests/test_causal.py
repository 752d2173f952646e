"""The causal loop with small deterministic models."""

import json
import sys

import numpy as np
from pyspark import cloudpickle

from hushline.operators.causal import NOTHING, Conversation, Models, causal_loop, split

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def embed(texts):
    v = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float) + 1e-9
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def infer(window, profile):
    n = window.split(":")[0]
    return f"Sure [1]: {json.dumps([{'speaker': 'Speaker A', 'attribute': 'location', 'guess': 'Oslo', 'lines': [int(n)]}, {'speaker': 'a', 'attribute': 'mood', 'guess': 'x'}])}"


def rewrite(window, profile, examples):
    return "\n".join(f"edit {line.split(':')[0]} {line.split(': ', 1)[1].replace('Oslo', 'a city')}" for line in window.splitlines())


def test_step_carries_profile_and_memory():
    talk = Conversation(Models(infer, rewrite, embed))
    a = talk.step({1: ("speaker_a", "I live in Oslo"), 2: ("speaker_b", "ok")})
    assert [x["after"] for x in a["lines"]] == ["speaker_a: I live in a city", "speaker_b: ok"]
    assert a["retrieved"] == [NOTHING] and a["errors"] == ["record 1: rejected"]
    assert [(f["speaker"], f["guess"]) for f in a["facts"]] == [("speaker_a", "Oslo")]
    b = talk.step({3: ("speaker_a", "I live in Oslo too")})
    assert b["facts"] == [] and b["retrieved"] == ["Original: speaker_a: I live in Oslo\nChanged: speaker_a: I live in a city\n[2] speaker_b: ok\n[3] speaker_a: I live in Oslo too"]


def test_edit_rules():
    prose = "edit 1\nEDIT 2 : speaker_x: new\nedit 3 bare words\nedit 4 speaker_a: first\nedit 4 speaker_a: last\nedit 5 speaker_a: " + "long " * 30 + "\nedit 9 speaker_a: x\nedit 6 speaker_a: same"
    talk = Conversation(Models(lambda w, p: "[]", lambda w, p, e: prose, embed))
    got = talk.step({n: ("speaker_a", "same") for n in range(1, 7)})
    assert [x["after"] for x in got["lines"]] == [None, "speaker_a: new", "speaker_a: bare words", "speaker_a: last", "speaker_a: same", "speaker_a: same"]
    assert got["errors"] == ["edit 2: speaker repaired", "edit 3: speaker label missing", "edit 5: too long", "edit 9: outside the window"]
    assert [n for n, _, _ in talk.edits] == [2, 3, 4]


def test_failing_models_leave_the_window():
    def fail(*_):
        raise OSError("down")

    got = Conversation(Models(fail, fail, embed)).step({1: ("a", "x")}, passes=2)
    assert [x["after"] for x in got["lines"]] == ["a: x"] and got["errors"] == ["infer: OSError: down", "rewrite: OSError: down"] * 2
    assert Conversation(Models(lambda w, p: "no json", rewrite, embed)).step({1: ("a", "x")})["errors"][0] == "payload: malformed"


def test_loop_over_conversations(spark):
    assert split([(1, 5), (2, 6), (3, 30), (4, 1)], 10) == [[(1, 5)], [(2, 6)], [(3, 30)], [(4, 1)]]
    rows = [(1, 2, "speaker_b", "Oslo is cold", 3), (1, 1, "speaker_a", "I live in Oslo", 4), (1, 3, None, None, None), (2, 1, "speaker_a", "hi", 1), (1, None, "x", "y", 1)]
    lines = spark.createDataFrame(rows, "conv_id long, line_no int, speaker string, text string, tokens int")
    got = {(r.conv_id, r.window_id): r for r in causal_loop(lines, lambda: Models(infer, rewrite, embed), budget=4).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert [x.after for x in got[1, 1].lines] == ["speaker_b: a city is cold", "speaker_a: "]
    assert got[1, 1].facts == [] and got[2, 0].facts[0].guess == "Oslo"
    assert causal_loop(lines.limit(0), lambda: Models(infer, rewrite, embed)).count() == 0
