"""Recovery, shapes and the order of checks."""

import pytest
from pyspark.sql import functions as F

from hushline import catalog
from hushline.functions import payloads

GOOD = '{"speaker": "Speaker A", "attribute": "Identity", "guess": "a nurse"}'


@pytest.mark.parametrize(
    ("text", "status", "value"),
    [
        (None, "malformed", None), ("", "malformed", None), ("no brackets", "malformed", None), ("[]", "valid_empty", []), ("see [] only", "valid_empty", []),
        ('[{"a": 1}]', "valid", [{"a": 1}]), ('Line [1] says: {"a": "x]"} indeed', "repaired", {"a": "x]"}), ('[{"a": 1,}, ', "repaired", [{"a": 1}]),
        ('{"a": [{"b": "cut of', "repaired", {"a": [{"b": "cut of"}]}), ('{"a":', "repaired", {"a": None}), ('[{"a": "q\\"x"', "repaired", [{"a": 'q"x'}]),
    ],
)
def test_recovery(text, status, value):
    assert payloads.recover(text) == (value, status)


def test_shapes():
    want = [{"speaker": "speaker_a", "attribute": "identity", "guess": "x"}]
    nested = [{"speaker": "speaker_a", "identity": ["x"]}]
    for payload in (want, {"records": want}, {"inferences": want}, nested, {"speakers": nested}, {"speaker_a": {"identity": [{"guess": "x"}]}}, want[0]):
        assert payloads.flatten(payload) == want
    assert payloads.flatten([{"speaker": "speaker_a", "identity": "x"}]) is None


def test_first_failing_check_is_the_reason(spark):
    def record(**change):
        return {"speaker": "Speaker A", "attribute": "Identity", "guess": "a nurse"} | change

    import json

    cases = [
        (record(), None), (record(guess=" A  NURSE"), "duplicate"), ("loose", "not an object"), (record(speaker=7), "speaker missing"), (record(attribute=" "), "attribute missing"), (record(guess=None), "guess missing"),
        (record(speaker="speaker_"), None), (record(speaker="__"), "speaker empty"), (record(attribute="mood", guess="none"), "unknown attribute"), (record(guess="x" * 1001), "guess too long"), (record(guess="None; nothing"), "no inference"),
        (record(guess="someone"), "generic guess"), (record(guess="b", lines=[1, 9]), "line references"), (record(guess="b", lines="1"), "line references"), (record(guess="b", line_refs=[1, 2]), None),
    ]
    own = spark.createDataFrame([(1, json.dumps([c for c, _ in cases])), (2, "[]"), (3, None), (4, json.dumps([record()] * 101))], "id long, text string")
    found = payloads.recovered(own, "id", "text")
    assert {r.id: r.status for r in found.collect()} == {1: "records", 2: "valid_empty", 3: "malformed", 4: "malformed"}
    got = [r.reason for r in payloads.validated(found, "id", F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).orderBy("at").collect()]
    assert got == [why for _, why in cases]
    assert payloads.recovered(own.limit(0), "id", "text").count() == 0


def test_query_reasons(spark):
    got = catalog.queries()["payload_validation"](spark, "/root/testdata/sf0.001").groupBy("reason").count().collect()
    assert {"duplicate", "unknown attribute", None} <= {r.reason for r in got}


def test_single_quotes_and_bare_words():
    assert payloads.recover("x {'speaker': 'it's me', ok: True, n: 1e5, 'w': None, v: two words,}") == ({"speaker": "it's me", "ok": True, "n": 1e5, "w": None, "v": "two words"}, "repaired")
    assert payloads.recover('[{guess: "don\'t", \'lines\': [1, 2]') == ([{"guess": "don't", "lines": [1, 2]}], "repaired")
    assert payloads.recover("see [note] and {sic}") == (None, "malformed")


def test_payloads_hold_whole_turns(spark, tmp_path):
    texts = ['He said "no" \\ 7 TIMES, ' + "x" * 50, "line\n\ttab \x01 end é \U0001d4b3 [1] {a: 'b'}", "word " * 220, "fine", "a" * 1000, "b" * 1001, "", "]}"]
    turns = [(0, 3, 4, 6, 7, 8, 11, 12)[k] for k in range(len(texts))]  # the others' guesses are fixed
    df = spark.createDataFrame([(1, turns[k], "user", t) for k, t in enumerate(texts)] + [(2, 0, "user", None)], "conv_id long, turn int, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.turn_id, r.at): r for r in catalog.queries()["payload_validation"](spark, str(tmp_path)).collect()}
    assert {k for k, _ in got} == {100 + k for k in turns}
    for k, t in zip(turns, texts, strict=True):
        guess = t.strip(" ")
        first = "unknown attribute" if k % 4 == 3 else "guess too long" if len(guess) > 1000 else None
        assert (got[100 + k, 0].guess, got[100 + k, 0].reason) == (guess, "guess missing" if not guess else first)
        assert got[100 + k, 1].guess == guess
