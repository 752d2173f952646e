"""All ten operators on one table with null and repeated ids, equal rows, a very long text, and columns of awkward names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hushline.llm")
from hushline.llm import decontaminate, licenses, lm, mixing, pii, quality, rules, simhash, suffixes, tokens  # noqa: E402

RND = random.Random(23)
VOCABULARY = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(400)]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n))


A, B, C, LONG = prose(60), prose(70) + " a@b.example under the MIT license", prose(50), "\n".join(prose(40) for _ in range(1500))
LINE = "the one line of the house"
#: (doc_id, text, source)
ROWS = [(None, A, "s0"), (None, B, "s1"), (None, B, "s1"), (None, None, None), (5, C, "s0"), (5, C, "s0"), (5, prose(45), "s1"), (None, "", ""), (7, None, "s2"), (8, LONG, "s1"), (9, "one", None), (10, "\n \t", "s2")]
ROWS += [(11, f"{prose(30)}\n{LINE}\n{prose(5)}", "s3") for _ in range(12)]  # one document in twelve rows: its line is no boilerplate
ROWS += [(100 + k, f"{prose(30)}\n{LINE}\n{prose(5)}", "s4") for k in range(12)]  # twelve documents: it is
AWKWARD = ("_quota", "_shard", "_source", "_of", "_shard_size", "_rank", "_hash", "_text", "_scored_text", "_times", "_copy", "_id", "_h", "size", "score", "predicted", "row", "hash", "first", "target", "taken", "source_size", "own", "words", "shard", "of", "at", "start", "end", "kind", "bucket", "range", "slab", "fp", "root", "n", "other", "host", "lines")
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in AWKWARD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *[f"{c} of {k % 3}" for c in AWKWARD]) for k, r in enumerate(ROWS)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def bag(rows):
    return collections.Counter(rows)


def each(f):
    return bag((k, *f(t or "")) for k, t, _ in ROWS)


def test_lm(docs, empty):
    words = [(t or "").encode().lower().split() for _, t, _ in ROWS]
    counts = [collections.Counter(tuple(w[i - n : i + 1]) for w in words for i in range(n, len(w))) for n in range(3)]
    total, want = sum(counts[0].values()), []
    for (k, _, _), w in zip(ROWS, words, strict=True):
        s = 0.0
        for i in range(len(w)):
            n = max(n for n in range(min(2, i) + 1) if n == 0 or counts[n][tuple(w[i - n : i + 1])] >= 2)
            g = tuple(w[i - n : i + 1])
            s += math.log(0.4 ** (2 - n) * counts[n][g] / (counts[n - 1][g[:-1]] if n else total))
        want.append((k, len(w), round(s, 5)))
    assert bag((r.doc_id, r.n_words, round(r.score, 5)) for r in lm.lm_scores(docs).collect()) == bag(want)
    assert lm.lm_scores(empty).collect() == []


def test_licenses(docs, empty):
    want = each(lambda t: (len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())), int("MIT" in t), "mit" if "MIT" in t else ""))
    assert bag((r.doc_id, r.n_words, r.n_base, r.labels) for r in licenses.license_scan(docs).collect()) == want
    assert licenses.license_scan(empty).collect() == []


def test_tokens(docs, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_tokenizer())
    monkeypatch.setattr(tokens, "PART_BYTES", 100_000)
    encoded = {t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, _ in ROWS}
    got = sorted(tokens.token_table(docs, folder=str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == bag((k, len(encoded[t]), zlib.crc32(encoded[t].tobytes())) for k, t, _ in ROWS)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.doc_id for r in got] == sorted((k for k, _, _ in ROWS), key=lambda k: (k is not None, k or 0))
    assert tokens.token_table(empty, folder=str(tmp_path / "e")).collect() == []


def test_token_files_by_sequence(docs, tmp_path):
    """Files of a few sequences, read one sequence at a time: views of the mapped file, whose masks tell the padding."""
    small, folder = 16, str(tmp_path / "f")
    index = tokens.write_files(docs, folder, sequence=small).orderBy("task", "part", "at").collect()
    for name in {r.file for r in index}:
        file = tokens.SequenceFile(folder, name)
        total = sum(r.n_tokens for r in index if r.file == name)
        assert len(file) == -(-total // small)
        run = np.concatenate([file[i][0][file[i][1].to_numpy(zero_copy_only=False)] for i in range(len(file))])
        plain = [b.to_pydict() for b in pa.ipc.open_stream(str(tmp_path / "f" / name))]
        assert run.tolist() == [x for b in plain for ids, mask in zip(b["ids"], b["mask"], strict=True) for x, m in zip(ids, mask, strict=True) if m] and len(run) == total
        assert all(len(file[i][0]) == small and not file[i][0].flags.owndata for i in range(len(file)))
        for r in index:
            if r.file == name:
                assert file.ids(r.at, r.n_tokens).tolist() == run[r.at : r.at + r.n_tokens].tolist() and run[r.at + r.n_tokens - 1] == 2
        with pytest.raises(IndexError):
            file[len(file)]


def test_files_end_at_a_bound(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_IDS", 500)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    index = tokens.write_files(docs, str(tmp_path / "b"))
    assert index.select("file").distinct().count() > 5
    assert [r.start for r in sorted(tokens.read_documents(index, str(tmp_path / "b")).collect(), key=lambda r: r.start)][1:] == np.cumsum([r.n_tokens for r in index.orderBy("task", "part", "at").collect()])[:-1].tolist()


def test_personal_data(docs, empty):
    want = each(lambda t: (int("a@b" in t), f"email:{t.index('a@b')}:{t.index('a@b') + 11}" if "a@b" in t else ""))
    assert bag((r.doc_id, r.n_email, r.spans) for r in pii.personal_data(docs).collect()) == want
    assert pii.personal_data(empty).collect() == []


def test_decontamination(docs, empty, spark):
    items = spark.createDataFrame([(1, A), (1, A), (None, C), (4, None), (5, " \n")], "item_id long, text string")
    got = bag((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    assert got == {(None, 1): 2, (5, None): 2}
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 3
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.decontaminated(empty, items).collect() == []
    assert decontaminate.leaks(docs, items.limit(0)).collect() == [] and decontaminate.decontaminated(docs, items.limit(0)).count() == len(ROWS)


def test_repeated_strings(docs, empty, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 100_000)
    seen, want = set(), []
    for k, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        want.append((k, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert bag((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.without_repeats(docs).collect()) == bag(want)
    assert suffixes.without_repeats(empty).collect() == []


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100, 112)] + [(None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model)
    assert got.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    want = {t: float(model.score(np.array([quality.features((t or "").encode())]))[0]) for _, t, _ in ROWS}
    assert bag((r.doc_id, r.text, round(r.score, 9)) for r in got.collect()) == bag((k, t, round(want[t], 9)) for k, t, _ in ROWS)
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert bag((r.doc_id, r.text, r.score) for r in kept.collect()) == bag((r.doc_id, r.text, r.score) for r in docs.collect() if want[r.text] >= quality.CUTOFF)
    assert quality.scored(empty, model).collect() == [] and quality.keep_good(empty, labels).collect() == []


def test_boosting_learns_pairs():
    """A label that only two features together tell: the pair tables carry it; each table alone is flat."""
    x = np.random.default_rng(2).random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95
    alone = quality.fit(x[:3000], y[:3000], pairs=0)
    assert ((alone.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() < 0.6
    plain = model.intercept + sum(model.tables[k][np.searchsorted(model.edges[k], x[:50, k], "right")] for k in range(3)) + sum(t[np.searchsorted(model.edges[i], x[:50, i], "right"), np.searchsorted(model.edges[j], x[:50, j], "right")] for i, j, t in model.pairs)
    assert np.allclose(model.score(x[:50]), 1 / (1 + np.exp(-plain)))


def test_simhash(docs, empty):
    fps = [simhash.fingerprint((t or "").encode()) for _, t, _ in ROWS]
    own = list(range(len(ROWS)))
    for _ in ROWS:
        own = [min(own[j] for j in range(len(ROWS)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(ROWS))]
    least = {c: min((k for (k, _, _), o in zip(ROWS, own, strict=True) if o == c and k is not None), default=None) for c in set(own)}
    want = bag((k, f"{f:016x}", least[c]) for (k, _, _), f, c in zip(ROWS, fps, own, strict=True))
    assert bag(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(own))
    classes = {(k, t): c for (k, t, _), c in zip(ROWS, own, strict=True)}
    assert len({classes[r.doc_id, r.text] for r in kept.collect()}) == len(set(own))
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_rules(docs, empty):
    got = rules.judged(docs)
    assert got.count() == len(ROWS)
    left = {r.doc_id: r.n_words - r.n_left for r in got.where("doc_id >= 11").collect()}
    assert left == {11: 0} | {100 + k: 6 for k in range(12)}
    assert bag((r.doc_id, r.n_words) for r in got.collect()) == each(lambda t: (len(SPACE.findall(t)),))
    assert got.where("kept").count() == got.where("NOT base_failed").where("kept").count() > 0  # a filter finishes
    assert rules.judged(empty).collect() == []


def test_mixing_takes_selected_blocks(docs, empty, monkeypatch):
    """taken, against the quotas and selected blocks worked out row by row."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    got = mixing.mix(docs).collect()
    assert mixing.mix(docs).columns == [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")] + ["size", "source_size", "target", "taken"]
    assert [r.taken for r in sorted(mixing.mix(docs.repartition(3)).collect(), key=str)] == [r.taken for r in sorted(got, key=str)]
    size = {t: len(SPACE.findall(t or "")) for _, t, _ in ROWS}
    assert bag((r.doc_id, r.text, r.source, r["size"]) for r in got) == bag((k, t, s, size[t]) for k, t, s in ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    from pyspark.sql import functions as F

    rest = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    hashes = docs.select("text", "source", F.xxhash64(F.lit(mixing.SEED), *[F.col(f"`{c}`") for c in rest]).alias("h")).collect()
    totals = collections.Counter()
    for _, t, s in ROWS:
        totals[s] += size[t]
    want = collections.Counter()
    for source, n, target, blocks, shards in mixing.source_quotas(list(totals.items())):
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 60 * shards
        lie = [sorted((h, size[t]) for t, s, h in hashes if s == source and h % shards == shard) for shard in range(shards)]
        held = [x for x in lie if x]
        for rows, (own, passes, further, factor, shift) in zip(held, mixing.shard_quotas([sum(n for _, n in x) for x in held], blocks, mixing.BLOCK, mixing.MOST, mixing.SEED), strict=True):
            words = sum(n for _, n in rows)
            chosen = {b for b in range(own) if (factor * b + shift) % own < further}
            assert len(chosen) == further
            of_word = [b for b in range(own) for _ in range((b + 1) * words // own - b * words // own)]
            at = 0
            for _, n in rows:
                want[source, n, passes * n + sum(b in chosen for b in of_word[at : at + n])] += 1
                at += n
    assert bag((r.source, r["size"], r.taken) for r in got) == want
    whole = mixing.mixed(docs)
    assert whole.schema == docs.schema and mixing.mixed(empty).collect() == [] and mixing.mix(empty).collect() == []
    assert whole.count() == sum(math.floor(r.taken / r["size"] + 0.5) for r in got if r["size"])


def test_targets_against_small_steps():
    """Water filling: the excess of capped sources is shared again by weight until none is above."""
    for seed in range(200):
        rnd = random.Random(seed)
        sizes = [rnd.choice([0, 1, 7, 100, 1000]) * rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))]
        weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
        low, high = 0.0, 1e7  # the level: each source gets weight * level, twice its size at most
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(w * mid, 2 * n) for w, n in zip(weights, sizes, strict=True)) < 1.5 * sum(sizes) else (low, mid)
        assert mixing.targets(sizes) == pytest.approx([min(w * high, 2 * n) for w, n in zip(weights, sizes, strict=True)], rel=1e-6, abs=1e-6)


def edits(pattern, words):
    """Least edits between pattern and any run of words, by the plain recurrence."""
    row = [0] * (len(words) + 1)
    for w in pattern:
        following = [row[0] + 1]
        for j, x in enumerate(words):
            following.append(min(row[j] + (w != x), row[j + 1] + 1, following[j] + 1))
        row = following
    return min(row)


def test_decontamination_against_every_pair():
    """Inserted, deleted and replaced words up to and over the budget, and short items, against every item in every text."""
    items = [[RND.choice(VOCABULARY) for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 9, 10, 14, 15, 20, 25, 30, 45, 59, 80) for _ in range(4)]
    items += [items[0] + items[1] + items[40] + [f"end{k}"] for k in range(6)]  # runs that many items share
    texts = []
    for w in items:
        for extra in (0, 1):
            changed, budget = list(w), len(w) // 5 + extra
            for _ in range(RND.choice((0, budget, budget, budget))):
                at = RND.randrange(len(changed) + 1)
                what = RND.choice("idr")
                if what == "i" or not changed:
                    changed.insert(at, RND.choice(VOCABULARY))
                elif what == "d":
                    del changed[min(at, len(changed) - 1)]
                else:
                    changed[min(at, len(changed) - 1)] = RND.choice(VOCABULARY)
            texts.append([RND.choice(VOCABULARY) for _ in range(RND.randint(0, 30))] + changed + [RND.choice(VOCABULARY) for _ in range(RND.randint(0, 30))])
    block = decontaminate.Items(list(range(len(items))), [" ".join(w) for w in items])
    got = {(t, i): e for t, i, _, _, e in block.find(pa.array([" ".join(t) for t in texts]))}
    want = {(t, i): e for t, text in enumerate(texts) for i, w in enumerate(items) if (e := edits(w, text)) <= len(w) // 5}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.99 * len(want) and len(want) > 150
    short = {k for k in want if len(items[k[1]]) < 5}
    assert short and short <= set(got)


def test_tables_reject_unrelated_windows():
    items = [[RND.choice(VOCABULARY) for _ in range(30)] for _ in range(200)]
    block = decontaminate.Items(list(range(200)), [" ".join(w) for w in items])
    other = np.random.default_rng(1).integers(0, len(block.vocabulary) + 1, (500, 30))
    assert len(np.unique(block.candidates(other, np.full(500, 30))[0])) < 150
    window, item = block.candidates(np.stack(block.words), np.full(200, 30))
    assert set(zip(range(200), range(200))) <= set(zip(window.tolist(), item.tolist()))
