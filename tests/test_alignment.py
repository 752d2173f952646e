"""Re-timing of rewritten lines."""

from hushline.functions import alignment

SOURCE = [("My", 0.0, 0.5), ("name", 0.5, 1.0), ("is", 1.0, 1.25), ("Alice", 1.25, 2.0), ("today.", 2.0, 3.0)]


def test_kept_words_keep_their_times_and_new_ones_share_the_span():
    got = [(w["word"], w["start"], w["stop"], w["kept"]) for w in alignment.retimed(SOURCE, "my name is [a person] today", 0, 3)]
    assert got[:3] == [("my", 0.0, 0.5, True), ("name", 0.5, 1.0, True), ("is", 1.0, 1.25, True)]
    assert got[3:] == [("[a", 1.25, 1.357, False), ("person]", 1.357, 2.0, False), ("today", 2.0, 3.0, True)]


def test_inserted_words_have_no_width():
    assert [(w["start"], w["stop"]) for w in alignment.retimed(SOURCE, "oh My name really is Alice today.", 0, 3)][:4] == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_near_spellings_and_lines_without_words(spark):
    assert alignment.pairing(["recognised", "x"], ["recognized", "x"]) == {0: 0, 1: 1}
    assert alignment.retimed([], "one two", 1, 2) == [{"word": "one", "start": 1.0, "stop": 1.5, "kept": False}, {"word": "two", "start": 1.5, "stop": 2.0, "kept": False}]
    own = spark.createDataFrame([(1, SOURCE, "My", 0.0, 3.0), (2, None, None, 0.0, 1.0)], "id long, words array<struct<word:string,start:double,stop:double>>, text string, start double, stop double")
    got = {r.id: r.words for r in alignment.retimed_lines(own, "id").collect()}
    assert [w.word for w in got[1]] == ["My"] and got[2] == []
