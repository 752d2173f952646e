"""Readers and sinks on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from hushline.sources import sinks, transcripts


def got(df):
    return [(r.n, r.speaker, r.text) for r in df.orderBy("file", "at", "n").collect()]


def test_text_records(spark, tmp_path):
    text = "1: speaker_x: hello: there\n\n  2 : Ann B.: hi \r\nplain words\n12: x: y\n9: 7 apples\n:odd"
    want = [(1, "speaker_x", "hello: there"), (2, "Ann B.", "hi"), (3, "speaker_a", "plain words"), (4, "x", "y"), (5, "speaker_a", "7 apples"), (6, "speaker_a", ":odd")]
    (tmp_path / "a.txt").write_bytes(text.encode())
    assert got(transcripts.load_records(spark, str(tmp_path / "a.txt"))) == want
    assert got(transcripts.load_records(spark, text)) == want
    assert got(transcripts.load_records(spark, "no_such_file")) == [(1, "speaker_a", "no_such_file")]


def test_json_records(spark, tmp_path):
    records = [{"text": "b: one\ntwo"}, {"turns": [{"speaker": "s", "text": "t"}, {"text": "u"}, ["p", "q"]]}, [["x", "y"]], {"turns": []}, {"other": 1}]
    want = [(1, "b", "one"), (2, "speaker_a", "two"), (1, "s", "t"), (2, "speaker_a", "u"), (3, "p", "q"), (1, "x", "y")]
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, records)))
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(records[1]))
    assert got(transcripts.load_records(spark, str(tmp_path / "a.jsonl"))) == want
    assert got(transcripts.load_records(spark, str(tmp_path / "a.json"))) == want
    assert got(transcripts.load_records(spark, str(tmp_path / "one.json"))) == want[2:5]


def test_strict_and_lenient_jsonl(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    bad.write_text('{"a": 1}\n\n[2]\n{"a": \n')
    assert transcripts.strict_jsonl(spark, str(good)).count() == 2
    with pytest.raises(ValueError, match="b.jsonl:3"):
        transcripts.strict_jsonl(spark, str(bad))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    assert sorted(r.a for r in transcripts.lenient_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 3]


def test_corpus_with_manifest(spark, tmp_path):
    for name, body in {"c1": 'z,"hi, ""you""\nthere"\ny,two\nz,three\n', "c2": "q,x\n", "c4": ""}.items():
        (tmp_path / name / "t").mkdir(parents=True)
        (tmp_path / name / "t" / "f.csv").write_text("speaker,utterance\n" + body)
    manifest = spark.createDataFrame([("c1",), ("c3",), ("c4",), ("c1",)], "conversation_id string")
    rows = transcripts.corpus(spark, f"{tmp_path}/*/t/*.csv", manifest)
    assert [tuple(r) for r in rows.orderBy("n").collect()] == [("c1", 1, "speaker_a", 'hi, "you"\nthere'), ("c1", 2, "speaker_b", "two"), ("c1", 3, "speaker_a", "three")]
    assert sorted(r[0] for r in transcripts.skipped(rows, manifest).collect()) == ["c3", "c4"]
    assert transcripts.corpus(spark, f"{tmp_path}/*/t/*.csv").count() == 4


def test_diarisation(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"start": 1, "end": 2, "speaker": "b"}, {"start": 0, "end": 1.5, "speaker": "a"}, {"start": 0, "end": 0.5, "speaker": "b"}]))
    assert {r.speaker: [tuple(s) for s in r.spans] for r in transcripts.diarisation(spark, str(p)).collect()} == {"a": [(0.0, 1.5)], "b": [(1.0, 2.0), (0.0, 0.5)]}
    for wrong in ({"start": 1, "end": 1, "speaker": "a"}, {"start": 0, "end": 1, "speaker": ""}, {"end": 1, "speaker": "a"}):
        p.write_text(json.dumps([wrong]))
        with pytest.raises(Exception, match="bad segment 0"):
            transcripts.diarisation(spark, str(p)).collect()


def test_labels(spark, tmp_path):
    item = {"reasoning": "r", "value": "v", "lines": [1, 2], "certainty": 3}
    body = json.dumps({"speakers": [{"speaker": "a", "identity": [item, {"value": "v"}], "health": []}, {"speaker": "b", "mood": [item]}]})
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "labels.json").write_text(body)
    (tmp_path / "bad.json").write_text("no json")
    rows = transcripts.labels(spark, str(tmp_path)).collect()
    assert {(r.speaker, r.category, r.n, r.fine) for r in rows} == {("a", "identity", 0, True), ("a", "identity", 1, False), ("a", "health", None, False), ("b", "mood", 0, False), (None, None, None, False)}
    assert {r.sha256 for r in rows if r.speaker} == {hashlib.sha256(body.encode()).hexdigest()}


def test_sinks(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2, "b", "two"), (1, 1, "a", "one"), (2, 1, "a", "x")], "conv_id int, n int, speaker string, text string")
    sinks.transcripts(turns, str(tmp_path / "t"), apart=True)
    read = transcripts.load_records(spark, str(tmp_path / "t" / "conv_id=1"))
    assert got(read) == [(1, "a", "one"), (2, "b", "two")]
    sinks.jsonl(turns, str(tmp_path / "j"), "text")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    rows = spark.createDataFrame([("c2", "test", 1), ("c1", "val", 2)], "conversation_id string, split string, extra int")
    sinks.manifest(rows, str(tmp_path / "m"), ["conversation_id", "split"], "test")
    assert spark.read.text(str(tmp_path / "m")).where(F.col("value") != "conversation_id,split").collect()[0][0] == "c2,test"
    paths = spark.createDataFrame([("/a/manifest.json",), ("/a/raw.txt",)], "path string")
    assert [r[0] for r in sinks.allowed(paths, {"manifest.json"}).collect()] == ["/a/manifest.json"]


def test_bundle_and_logs(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2, "b", "two"), (1, 1, "a", "one"), (2, 1, "a", "x")], "conv_id int, n int, speaker string, text string")
    after = turns.withColumn("text", F.when(F.col("n") == 1, F.col("text")))
    times = spark.createDataFrame([(1, 0.5), (1, 0.1)], "conv_id int, start_seconds double")
    sinks.bundle(after, turns, times, times, str(tmp_path / "b"))
    read = {n: spark.read.json(str(tmp_path / "b" / n)) for n in ("raw_transcript", "anonymised_transcript", "trace")}
    assert {r.conv_id: r.transcript for r in read["raw_transcript"].collect()} == {1: "1: a: one\n2: b: two", 2: "1: a: x"}
    assert {r.conv_id: r.transcript for r in read["anonymised_transcript"].collect()} == {1: "1: a: one", 2: "1: a: x"}
    assert [r.start_seconds for r in read["trace"].collect()] == [0.1, 0.5]
    power = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5, 0.1, {"R": 2.5})], "unix_seconds double, monotonic_seconds double, aggregate_pmic_w double, vdd_core_w double, sample_duration_seconds double, rail_watts map<string,double>")
    sinks.power_log(power, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).first().rail_watts == '{"R":2.5}'


def test_states_rows_and_routes(spark, tmp_path):
    states = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1',), ("[1]",), (None,)], "t string")
    assert [r[0] for r in states.select(sinks.state_of(F.col("t"))).collect()] == [{"a": "1", "b": "x"}, {}, {}, {}]
    fields = spark.createDataFrame([("a", 'say "b", c', None)], "x string, y string, z string")
    assert fields.select(sinks.csv_row([F.col(c) for c in "xyz"])).first()[0] == 'a,"say ""b"", c",\n'
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert [(r.bytes, r.sha256) for r in sinks.artifacts_of(spark, str(tmp_path / "*.bin")).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]
    sent = sinks.delivered(spark.range(4), {"even": F.col("id") % 2 == 0, "all": F.lit(True)})
    assert sorted((r.sink, r.id) for r in sent.collect()) == [("all", 0), ("all", 1), ("all", 2), ("all", 3), ("even", 0), ("even", 2)]
