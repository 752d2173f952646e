"""Greedy matching against cases worked by hand."""

from hushline.operators import matching


def test_lead_beats_similarity():
    # channel 1 leads by 0.5 (strength 1.05), channel 0 by 0.1 (0.95)
    got = matching.greedy({(0, "a"): 0.9, (0, "b"): 0.8, (1, "a"): 0.8, (1, "b"): 0.3}, {0, 1}, {"a", "b"})
    assert [(m["channel"], m["speaker"], m["method"]) for m in got] == [(0, "b", "fingerprint"), (1, "a", "fingerprint")]
    assert got[1]["margin"] == 0.5 and got[0]["margin"] == 0.0


def test_rest_is_eliminated_or_ambiguous(spark):
    rows = [(1, 0, "a", 0.9), (1, 0, "b", None), (1, 1, "a", 0.2), (1, 1, "b", None), (2, 0, "a", 0.1), (2, 1, "b", None), (3, 0, None, 0.5)]
    pairs = spark.createDataFrame(rows, "id long, channel int, speaker string, similarity double")
    got = {(r.id, r.channel): (r.speaker, r.method, r.similarity) for r in matching.matched(pairs.union(pairs), "id").collect()}
    assert got == {(1, 0): ("a", "fingerprint", 0.9), (1, 1): ("b", "elimination", None), (2, 0): ("a", "ambiguous", None), (2, 1): ("b", "ambiguous", None)}
    assert matching.matched(pairs.limit(0), "id").count() == 0
