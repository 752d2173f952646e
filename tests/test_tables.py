"""Operators on small tables of their own: edges, ties, gaps and wrong input, against plain Python where it is short."""

import itertools
import json
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushline.operators import activity, lines, lookups, measures, memory
from hushline.plans import views
from hushline.streaming.control import desired

RND = random.Random(12)


def frame_table(spark, p):
    """p[slot][frame] of one recording."""
    return spark.createDataFrame([("r", s, k, x) for s, row in enumerate(p) for k, x in enumerate(row)], "rec string, slot int, frame long, p double")


def activity_of(p, threshold=0.5):
    """The median of three by sorting; the end frames stand in for their missing neighbours."""
    on = [[x >= threshold for x in row] for row in p]
    return [[sorted([row[max(k - 1, 0)], row[k], row[min(k + 1, len(row) - 1)]])[1] for k in range(len(row))] for row in on]


@pytest.fixture(scope="module")
def probabilities():
    return [[RND.choice((0.1, 0.5, 0.9, 0.9)) for _ in range(60)] for _ in range(5)]


def test_activity_and_segments(spark, probabilities):
    want = activity_of(probabilities)
    active = activity.activity(frame_table(spark, probabilities), ["rec"])
    got = {(r.slot, r.frame): r.active for r in active.collect()}
    assert got == {(s, k): want[s][k] for s in range(5) for k in range(60)}
    spans = []
    for s, row in enumerate(want):
        k = 0
        for on, run in itertools.groupby(row):
            n = len(list(run))
            if on and n / 10 >= 0.3:
                spans.append((s, f"SPEAKER_0{s}", round(k / 10, 3), round((k + n) / 10, 3)))
            k += n
    assert sorted((r.slot, r.speaker, r.start, r.stop) for r in activity.segments(active, ["rec"], 10, 0.3).collect()) == sorted(spans)
    one = activity.activity(frame_table(spark, [[0.9], [0.1]]), ["rec"])
    assert [(r.slot, r.start, r.stop) for r in activity.segments(one, ["rec"], 10).collect()] == [(0, 0.0, 0.1)]


def test_overlaps_top_slots_and_routes(spark, probabilities):
    on = activity_of(probabilities)
    active = activity.activity(frame_table(spark, probabilities), ["rec"])
    sets = [tuple(s for s in range(5) if on[s][k]) for k in range(60)]
    regions, k = [], 0
    for held, run in itertools.groupby(sets):
        n = len(list(run))
        if len(held) > 1 and n / 10 >= 0.2:
            regions += [(list(held), len(held), a / 10, min(a + 2, k + n) / 10) for a in range(k, k + n, 2)]
        k += n
    assert sorted((r.slots, r.speakers, r.start, r.stop) for r in activity.overlap_regions(active, ["rec"], 10, 0.2, 0.25).collect()) == sorted(regions)
    strongest = [tuple(sorted(sorted(held, key=lambda s: (probabilities[s][k], s))[-3:])) for k, held in enumerate(sets)]
    assert {r.frame: tuple(r.slots) for r in activity.top_slots(active, ["rec"]).collect()} == {k: x for k, x in enumerate(strongest) if x}
    routes, k = [], 0
    for held, run in itertools.groupby(strongest):
        n = len(list(run))
        if held:
            size = n if len(held) == 1 else 3
            routes += [(list(held), "pass" if len(held) == 1 else "separate", a, min(a + size, k + n) - 1) for a in range(k, k + n, size)]
        k += n
    got = activity.routes(active, ["rec"], 10, 0.3)
    assert sorted((r.slots, r.route, r.first, r.last) for r in got.collect()) == sorted(routes)
    ends = activity.with_context(got.withColumn("samples", F.lit(470)), 10, 80, 0.5).collect()
    assert all(r.core_start == r["first"] * 8 and r.core_stop == min(470, (r["last"] + 1) * 8) and r.context_start == max(0, r.core_start - 40) and r.context_stop == min(470, r.core_stop + 40) for r in ends)


def test_solo_clips_masks_and_gaps(spark):
    active = activity.activity(frame_table(spark, [[1.0] * 4 + [0.0] * 4 + [1.0] * 6 + [1.0] * 2, [0.0] * 12 + [1.0] * 4]), ["rec"])
    assert [(r.slot, r.rank, r.start, r.stop) for r in activity.solo_clips(active, ["rec"], 10, 100, 0.4).orderBy("slot", "rank").collect()] == [(0, 1, 0, 40), (0, 2, 80, 120)]
    marked = {(r.slot, r.frame): (r.solo, r.uncovered) for r in activity.masks(active, ["rec"], spark.createDataFrame([("r", 12, 13)], "rec string, first long, last long")).collect()}
    assert marked[0, 0] == (True, False) and marked[0, 12] == (False, False) and marked[1, 15] == (False, True) and len(marked) == 16
    frames = spark.createDataFrame([("r", 0, k, 1.0) for k in (0, 1, 4)], "rec string, slot int, frame long, p double")
    assert [(r.after, r.next) for r in activity.gaps(frames, ["rec"]).collect()] == [(1, 4)]
    assert [(r.slot, r.seconds) for r in activity.active_slots(active, ["rec"], 10, 0.1, 1).collect()] == [(0, 1.2)]


def test_features(spark):
    x = [float(RND.randint(0, 9)) for _ in range(11)]
    frames = frame_table(spark, [x])
    got = {r.frame: r.x for r in activity.less_running_mean(frames, ["rec"], "p").collect()}
    assert all(got[k] == pytest.approx(x[k] - np.mean(x[: k + 1])) for k in range(11))
    got = {r.frame: r.features for r in activity.stacked(frames, ["rec"], "p", 2, 3).collect()}
    assert got == {k: [x[min(max(k + s, 0), 10)] for s in range(-2, 3)] for k in (0, 3, 6)}  # the centre 9 has no whole stride
    row = spark.createDataFrame([(3, [9.0, 0.0, -1.0, 9.0], [1.0, 2.0])], "k int, logits array<double>, v array<float>")
    out = activity.emitted(row, "logits", "k", 0.5).first()
    assert out.probabilities == pytest.approx([0.5, 0.268941421]) and out["at"] == 1.5
    assert row.select(activity.fixed_length(F.col("v"), 1).alias("a"), activity.fixed_length(F.col("v"), 4).alias("b"), activity.core(F.col("logits"), F.lit(10), F.lit(11), F.lit(2)).alias("c")).first() == ([1.0], [1.0, 2.0, 0.0, 0.0], [0.0, -1.0])


def test_track_layout_writes_everything_once(spark):
    for seed in range(5):
        rnd = random.Random(seed)
        parts = sorted({(a, a + rnd.randint(1, 30)) for a in (rnd.randint(0, 80) for _ in range(6))})
        table = spark.createDataFrame([("t", a, b) for a, b in parts], "track string, start long, stop long")
        rows = activity.track_layout(table, ["track"], spark.createDataFrame([("t", 130)], "track string, samples long")).orderBy("start", "stop").collect()
        at = 0
        for r in rows:
            at += r.silence
            assert r.kept == 0 or at + r.kept == r.stop
            at += r.kept + r.silence_after
        assert at == 130


def test_chunks(spark):
    rows = activity.fixed_chunks(spark.createDataFrame([("a", 0), ("b", 7), ("c", 6)], "k string, n long"), 3).collect()
    assert sorted((r.k, r.chunk, r["first"], r.stop, r.final) for r in rows) == [("b", 0, 0, 3, False), ("b", 1, 3, 6, False), ("b", 2, 6, 7, True), ("c", 0, 0, 3, False), ("c", 1, 3, 6, True)]


LINES = [(1, "speaker_a", "one two"), (2, "speaker_b", "a: colon"), (4, "Speaker-A", "four"), (5, "speaker_a", ""), (9, "speaker_b", "nine")]


@pytest.fixture(scope="module")
def transcript(spark):
    return spark.createDataFrame([("c", *r) for r in LINES], "conv string, n int, speaker string, text string")


def test_line_forms(spark):
    given = ["3: speaker_a: hello: you", " 7 : b :x", "no number: b: x", "12: only two", "", "5:a:", "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, line string")
    c = F.col("line")
    got = {r.k: r for r in df.select("k", lines.text_of(c).alias("text"), lines.line_number(c).alias("n"), lines.context_line(c).alias("context"), lines.is_window_line(c).alias("fit")).collect()}
    assert [got[k].text for k in range(7)] == ["hello: you", "x", "no number: b: x", "12: only two", "", "", "x"]
    assert [got[k].n for k in range(7)] == [3, 7, None, 12, None, 5, None]
    assert [got[k].context for k in range(7)] == ["[3] speaker_a: hello: you", "[7] b :x", "no number: b: x", "[12] only two", "", "[5]a:", "x"]
    assert [got[k].fit for k in range(7)] == [True, True, False, False, False, True, False]
    names = spark.createDataFrame([("Speaker-A",), ("speaker a",), ("a",), ("speaker_speaker_a",), ("",)], "s string")
    assert [r[0] for r in names.select(lines.speaker_key(F.col("s"))).collect()] == ["speaker_a", "speaker_a", "speaker_a", "speaker_speaker_a", "speaker_"]
    text = spark.createDataFrame([("a \r\n\n b\nc",)], "t string")
    assert text.select(lines.one_line(F.col("t")), lines.one_line(F.col("t"), "reference")).first() == ("a b c", "a ")


def test_edits(spark, transcript):
    answer = "Sure:\nedit 1 speaker_a: changed\nEDIT 2: speaker_b: a: colon\nedit 4\nedit 5 speaker_a:\nedit 9 Speaker B: " + "x" * 60 + "\nedit 7 speaker_a: nowhere\nedit 1 no label\nedited 3 x"
    found = lines.edits(spark.createDataFrame([("c", answer)], "conv string, answer string"), ["conv"])
    assert [(r.n, r.replacement) for r in found.orderBy("ordinal").collect()] == [(1, "speaker_a: changed"), (2, ": speaker_b: a: colon"), (4, ""), (5, "speaker_a:"), (9, "Speaker B: " + "x" * 60), (7, "speaker_a: nowhere"), (1, "no label")]
    last = lines.last_wins(found, ["conv"])
    assert [(r.n, r.proposals, r.replacement) for r in last.orderBy("ordinal").collect()][0] == (1, 2, "no label")
    assert [r.n for r in lines.outside(last, transcript, ["conv"]).collect()] == [7]
    notes = {r.n: (r.replacement, r.note) for r in lines.normalised(last, transcript, ["conv"]).collect()}
    assert notes == {1: ("speaker_a: no label", "repaired missing speaker label 'speaker_a'"), 2: ("speaker_b: a: colon", None), 4: ("", None), 5: ("speaker_a: ", None), 9: ("speaker_b: " + "x" * 60, None)}
    done = {r.n: (r.text, r.outcome) for r in lines.applied(transcript, last, ["conv"]).collect()}
    assert done == {1: ("no label", "edited"), 2: ("a: colon", "unchanged"), 4: (None, "deleted"), 5: ("", "unchanged"), 9: ("nine", "too long")}
    wrong = spark.createDataFrame([("c", 0, 1, "speaker_z: other")], "conv string, ordinal int, n int, replacement string")
    assert lines.normalised(wrong, transcript, ["conv"]).first().note == "repaired speaker 'speaker_z' to 'speaker_a'"


def test_neighbours_and_rendered_edits(spark, transcript):
    got = {(r.n, r.other) for r in lines.neighbours(transcript, transcript, ["conv"]).collect()}
    numbers = [r[0] for r in LINES]
    assert got == {(a, b) for a in numbers for b in numbers if a != b and abs(a - b) <= 2}
    whole = transcript.select("conv", "n", lines.rendered(F.col("n"), F.col("speaker"), F.col("text")).alias("text"))
    done = spark.createDataFrame([("c", 4, "4: Speaker-A: four", "4: Speaker-A: ****"), ("c", 30, "b", "a")], "conv string, n int, before string, after string")
    entries = {r.n: r.entry for r in lines.rendered_edits(done, whole, ["conv"]).collect()}
    assert entries == {4: "[2] speaker_b: a: colon\nOriginal: 4: Speaker-A: four\nChanged: 4: Speaker-A: ****\n[5] speaker_a: ", 30: "Original: b\nChanged: a"}


def test_word_timings(spark):
    rows = spark.createDataFrame([(1, 1, "ab c, -- d", 2.0, 4.0), (1, 2, " ", 0.0, 1.0), (1, 3, "x", 5.0, 5.0)], "conv int, n int, text string, start double, stop double")
    got = [(r.n, r.word, r.start, r.stop) for r in lines.proportional_timing(rows, ["conv"]).orderBy("n", "place").collect()]
    assert got == [(1, "ab", 2.0, 2.8), (1, "c,", 2.8, 3.2), (1, "--", 3.2, 3.6), (1, "d", 3.6, 4.0), (3, "x", 5.0, 5.0)]
    assert [(r.word, r.start, r.stop) for r in lines.uniform_timing(rows.where("n <> 2"), ["conv"]).orderBy("n", "place").collect()] == [("ab", 2.0, 2.5), ("c,", 2.5, 3.0), ("--", 3.0, 3.5), ("d", 3.5, 4.0), ("x", 5.0, 5.001)]


def test_subwords(spark):
    pieces = [("▁Hel", 0.1), ("lo", 0.2), ("<unk>", 0.25), (" ,", 0.3), ("▁wor", 0.5), ("ld", 0.5), ("▁", 0.6), ("!", 0.9)]
    rows = spark.createDataFrame([("u", k, p, t, 0.0, 9.0) for k, (p, t) in enumerate(pieces)], "u string, place int, piece string, at double, line_start double, line_end double")
    got = [(r.word, r.start, r.stop) for r in lines.subword_timing(rows, ["u"]).orderBy("word_no").collect()]
    assert got == [("Hello,", 0.1, 0.5), ("world!", 0.5, 1.0)]


def test_retrieval(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # a tie
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item long, v array<double>")
    queries = table.where("item % 4 = 3").withColumnRenamed("item", "query")
    s = np.round(v @ v.T, 6)
    for candidates, top in ((6, 4), (3, 9)):
        want = {(q, i) for q in range(3, 40, 4) for i in sorted(range(40), key=lambda i: (-s[q, i], i))[: min(candidates, top)] if s[q, i] >= 0.2}
        found = memory.retrieved(queries, table, candidates, top, 0.2)
        assert {(r["query"], r.item) for r in found.collect()} == want
    assert {(r["query"], r.item) for r in memory.scores(queries, table, 5, 0.1, block=3).collect()} == {(q, i) for q in range(3, 40, 4) for i in sorted(range(40), key=lambda i: (-s[q, i], i))[:5] if s[q, i] >= 0.1}
    best = memory.merged(found.withColumn("w", F.lit(0)), ["w"]).orderBy("place").collect()
    assert [r.place for r in best] == list(range(1, len(best) + 1)) and [(r.score, r.item) for r in best] == sorted((r.score, r.item) for r in best)
    assert memory.retrieved(queries, table.limit(0)).collect() == [] and memory.retrieved(queries.limit(0), table).collect() == []
    with pytest.raises(ValueError):
        memory.check(0, 1)


def test_retrieval_over_many_partitions(spark):
    """Blocks meet all parts however the groups are dealt to tasks: both sides' keys are of one type."""
    v = np.random.default_rng(5).standard_normal((300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item long, v array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = memory.scores(table.where("item % 4 = 3").withColumnRenamed("item", "query"), table, 5, 0.1, block=10).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    s = np.round(v @ v.T, 6)
    assert sorted((r["query"], r.item, r["rank"]) for r in got) == [(q, i, k + 1) for q in range(3, 300, 4) for k, i in sorted(enumerate(sorted(range(300), key=lambda i: (-s[q, i], i))[:5]), key=lambda x: x[1]) if s[q, i] >= 0.1]


#: Ids and vectors: ten copies before a query and ten after; halves at the sixth place; missing vectors and numbers, short vectors.
COPIES = [(k, [0.5, 0.5, 0.5, 0.5]) for k in (*range(1, 11), 20, *range(50, 60))] + [(k, [0.5, -0.5, 0.5, -0.5]) for k in (11, 40)]
HALVES = [(40, [0.125, 0.5, 0.5, 0.6875]), *((k, [0.0625, 0.5, 0.25, k / 128]) for k in range(57, 65))]
GAPS = [(0, [0.5, 0.5, 0.5, 0.5]), (100, None), (101, None), (120, [0.25, None, 0.75, 0.5]), (140, [1.0, 0.5]), (141, [None, 0.75, 0.5])]


def _by_sql(table, name, tmp_path):
    table.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    found = con.sql(views.SQL[name])
    return found.columns, sorted(found.fetchall())


@pytest.mark.parametrize("vectors", [COPIES, HALVES, GAPS])
def test_retrieval_of_copies_and_odd_vectors(spark, tmp_path, vectors):
    """Eight at most for each query, though the vector itself isn't always among its nine best."""
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    columns, want = _by_sql(table, "retrieval_top_k", tmp_path)
    got = views.QUERIES["retrieval_top_k"](lambda _: table).select(columns).collect()
    assert want and sorted(map(tuple, got)) == want


@pytest.mark.parametrize("vectors", [COPIES, HALVES, GAPS, [(k - 80, v) for k, v in COPIES], [(k + 2**62 + 16, v) for k, v in COPIES]])
def test_merge_of_copies_and_odd_vectors(spark, tmp_path, vectors):
    """Windows of a hundred ids are told by whole numbers, for ids below 0 and beyond 2^53 too."""
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    columns, want = _by_sql(table, "retrieval_merge", tmp_path)
    got = views.QUERIES["retrieval_merge"](lambda _: table).select(columns).collect()
    assert want and sorted(map(tuple, got)) == want


def test_retrieval_holds_a_tile_at_a_time():
    """20,000 vectors against 2,000 queries, half of them copies: 320 MB of scores, of which a task holds a few tiles and sends eight each."""
    v = np.random.default_rng(6).standard_normal((20_000, 16))
    v[::2] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 16).cast(pa.list_(pa.float64()))
    own, asked = pa.table({"item": np.arange(20_000)[::-1], "v": lists}), pa.table({"query": np.arange(2000), "v": lists[:2000]})
    tracemalloc.start()
    try:
        got = memory.met(asked, own, 16, 8, -1.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 16_000 and peak < 100e6
    assert got.slice(0, 8).column("item").to_pylist() == list(range(1, 17, 2))


def test_profiles_and_first_seen(spark):
    rows = spark.createDataFrame([("c", 2, "é"), ("c", 1, "x")], "conv string, seq int, guess string")
    assert json.loads(memory.profile(rows, ["conv"], "seq", ["guess"]).first().profile) == [{"guess": "x"}, {"guess": "é"}]
    seen = spark.createDataFrame([("c", 1, 5, "late"), ("c", 1, 2, "early")], "conv string, n int, at int, text string")
    assert memory.first_seen(seen, ["conv"], "at").first().text == "early"


def test_power(spark):
    watts = [float(RND.randint(1, 500)) / 7 for _ in range(40)]
    rows = spark.createDataFrame([("r", float(k * k), w) for k, w in enumerate(watts)] + [("s", 1.0, 2.0)], "run string, at double, watts double")
    got = {r.run: r for r in measures.power_summary(rows, ["run"], 1.0).collect()}
    w = np.array(watts) - 1
    assert got["r"].p95_nearest == pytest.approx(sorted(w)[min(39, int(0.95 * 40))]) and got["r"].p95_linear == pytest.approx(np.percentile(w, 95))
    assert got["r"].energy == pytest.approx(np.trapezoid(w, [k * k for k in range(40)])) and got["r"].peak == pytest.approx(w.max()) and got["r"].duration == 39 * 39
    assert (got["s"].n, got["s"].energy, got["s"].p95_nearest, got["s"].p95_linear) == (1, 0.0, 1.0, 1.0)
    smooth = {r.at: r.smooth for r in measures.moving_average(rows, ["run"], "watts", 5).where("run = 'r'").collect()}
    assert smooth[0.0] == watts[0] and smooth[1.0] == watts[1] and smooth[4.0] == pytest.approx(np.mean(watts[:5])) and smooth[38.0 * 38] == watts[38]
    chip = spark.createDataFrame([("a", " 3V3_A current(1)=0.5A"), ("a", " 3V3_V volt(9)=2.0V"), ("a", "VDD_CORE_A current(2)=2.5A"), ("a", "VDD_CORE_V volt(3)=0.4V"), ("a", "LONE_A current(4)=9A"), ("a", "junk")], "t string, line string")
    got = measures.rails(chip, ["t"]).first()
    assert got.rail_watts == {"3V3": 1.0, "VDD_CORE": 1.0} and (got.total_w, got.core_w) == (2.0, 1.0)


def test_skips_at_and_around_a_moment(spark):
    skips = spark.createDataFrame([("s", 2.0, 5.0), ("s", 4.0, 1.0)], "k string, at double, skipped double")
    asked = spark.createDataFrame([("s", x, f"at {x}") for x in (1.0, 2.0, 3.0, 4.0, 9.0)] + [("t", 1.0, "alone")], "k string, at double, stage string")
    got = {(r.k, r["at"]): (r.offset, r.skip_at, r.stage) for r in measures.skip_offsets(skips, asked, ["k"]).collect()}
    assert got == {("s", 1.0): (0.0, None, "at 1.0"), ("s", 2.0): (5.0, 2.0, "at 2.0"), ("s", 3.0): (5.0, 2.0, "at 3.0"), ("s", 4.0): (6.0, 4.0, "at 4.0"), ("s", 9.0): (6.0, 4.0, "at 9.0"), ("t", 1.0): (0.0, None, "alone")}
    assert measures.skip_offsets(skips.limit(0), asked, ["k"]).where("offset = 0").count() == 6


def test_hysteresis_is_the_fold(spark):
    for low, high in ((1, 5), (3, 4)):
        samples = [(k, RND.randint(0, 8), RND.choice((None, 1.0, 99.0))) for k in range(200)]
        state, want = "background", []
        for _, depth, age in samples:
            state, _ = desired(state, depth, age, high, low, 90.0)
            want.append(state)
        rows = spark.createDataFrame([("q", *s) for s in samples], "q string, seq int, depth int, age double")
        assert [r.state for r in measures.hysteresis(rows, ["q"], "seq", high, low, 90.0).orderBy("seq").collect()] == want
    with pytest.raises(ValueError):
        measures.hysteresis(rows, ["q"], "seq", 3, 3, 1.0)


def test_queue(spark):
    moves = [1, 1, -1, 1, -1, -1, 1]
    rows = spark.createDataFrame([("q", k * 10, m) for k, m in enumerate(moves)], "q string, at int, change int")
    got = [(r["at"], r.depth, r.oldest) for r in measures.queue_depth(rows, ["q"], "at").orderBy("at").collect()]
    assert got == [(0, 1, 0), (10, 2, 0), (20, 1, 10), (30, 2, 10), (40, 1, 30), (50, 0, None), (60, 1, 60)]


def test_scores(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0, 3), ("b", 3.0, 5.0, 2), ("c", 2.0, 5.0, 3)], "k string, x double, y double, g int")
    assert {r.k: r.composite for r in measures.composite(rows, ["x", "y"]).collect()} == {"a": 0.5, "b": 1.0, "c": 0.75}
    assert {r.k: r.s for r in measures.bounds(rows, ["y"]).select("k", measures.scaled("y").alias("s")).collect()} == {"a": None, "b": None, "c": None}
    assert {r.k for r in measures.skyline(rows.withColumn("all", F.lit(1)), ["all"], "x", "g", "k").collect()} == {"a"}
    got = {r.k: (r.distance, r.behind) for r in measures.distance_to_best(rows, {"x": (1.0, 2.0)}).collect()}
    assert got == {"a": (0.0, 0.0), "b": (1.0, 1.0), "c": (0.5, 0.5)}
    u = spark.createDataFrame([(10, 5, 1), (0, 5, 1), (5, None, 0), (5, 5, 2)], "r int, m int, h int").select(measures.utility(F.col("r"), F.col("m"), F.col("h")).alias("u")).select("u.*")
    assert [(round(x.score, 6), x.error) for x in u.collect()] == [(0.833333, None), (0.0, "readability"), (0.0, "meaning"), (0.0, "hallucinations")]
    assert {r.g: (r.leakage, r["items"]) for r in measures.leakage(rows.select("g", F.when(F.col("g") == 3, F.col("x")).alias("score")), ["g"]).collect()} == {3: (1.5, 2), 2: (0.0, 0)}
    v = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 3), ("z", [0.0, 0.0], 1)], "k string, v array<double>, weight int")
    assert measures.mean_vector(v, ["k"]).first().v == pytest.approx([0.316227766, 0.948683298])


def test_lookups(spark):
    a = spark.createDataFrame([("g", 1), ("g", 4), ("h", 2)], "k string, n int")
    b = spark.createDataFrame([("g", 7)], "k string, n int")
    assert sorted((r.k, r.place, r.left.n, r.right and r.right.n, r.problem) for r in lookups.zipped(a, b, ["k"], "n").collect()) == [("g", 1, 1, 7, None), ("g", 2, 4, None, "uneven"), ("h", 1, 2, None, "uneven")]
    specs = ["0-3,5", "2", "3-1", "", "1,,2", "-1", "1-", "4,4,2-3", None]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    assert [r[0] for r in df.select(lookups.cpu_set(F.col("s"))).collect()] == [[0, 1, 2, 3, 5], [2], None, None, None, None, None, [2, 3, 4], None]
    names = spark.createDataFrame([("qwen-0.5B-v2",), ("a 350M or 7b",), ("none",)], "s string")
    assert [r[0] for r in names.select(lookups.size_in_billions(F.col("s"))).collect()] == [0.5, 7.0, None]
    nested = spark.range(1).select(lookups.prompt("{{A}} {{B}}", {"A": F.lit("x {{B}}"), "B": F.lit("y {{A}}")}).alias("p"))
    assert nested.first().p == "x y {{A}} y {{A}}"
    assert lookups.templates("----- SYSTEM\nbe kind\n----- USER\n{{WINDOW}}\n") == ("be kind", "{{WINDOW}}")
    with pytest.raises(ValueError):
        lookups.templates("----- ONE\nx")
    records = spark.createDataFrame([("s", 1, "A  b"), ("s", 2, "a B"), ("s", 3, "c"), ("t", 4, "a b")], "k string, at int, guess string")
    assert sorted(r["at"] for r in lookups.new_records(records, ["k"], F.col("guess"), "at", records.where("at = 3")).collect()) == [1, 4]


def test_sessions_and_endpoints(spark):
    chunks = spark.createDataFrame([("s", 0.0, 4.0), ("s", 4.01, 12.0), ("s", 14.0, 15.0), ("t", 3.0, 3.5)], "k string, start double, stop double")
    got = [(r.k, r.session, r.start, r.stop, r.boundary) for r in lookups.gap_pieces(chunks, ["k"], 0.02, 10.0).orderBy("k", "start").collect()]
    assert got == [("s", 0, 0.0, 10.0, "full"), ("s", 0, 10.0, 12.0, "gap"), ("s", 1, 14.0, 15.0, "end"), ("t", 0, 3.0, 3.5, "end")]
    got = [(r.k, r.utterance, r.start, r.stop, r.boundary) for r in lookups.endpoints(chunks, ["k"]).orderBy("k", "start").collect()]
    assert got == [("s", 1, 0.0, 13.2, "silence"), ("s", 2, 14.0, 15.0, "end"), ("t", 1, 3.0, 3.5, "end")]
