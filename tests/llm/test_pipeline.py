"""The corpus pipeline: its stages by hand on a small corpus, and on awkward rows."""

import collections
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("hushline.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from hushline.llm import decontaminate, mixing, quality, simhash, tokens  # noqa: E402

RND = random.Random(77)
VOCABULARY = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(500)]


def prose(n):
    return " ".join(RND.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


ITEM = prose(25)
GOOD = [prose(RND.randint(40, 90)) for _ in range(120)]
BAD = [" ".join(prose(3).upper() + "!!!" for _ in range(12)) for _ in range(60)]
ROWS = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(GOOD + BAD)]
COPIES = [(1000 + k, GOOD[k], "en", "s0", len(GOOD[k])) for k in range(10)]
LEAKS = [(2000 + k, f"{prose(30)} {ITEM.lower()} {prose(30)}", "en", "s1", 0) for k in range(5)]
AWKWARD = [(None, prose(60), None, None, None), (None, prose(60), "en", "s2", None), (None, GOOD[0], "en", "s2", None), (3000, None, "en", "s2", None), (3001, "", "en", "", 0), (0, prose(70), "de", "s3", 1), (3002, " ".join(prose(50) for _ in range(300)), "en", "s1", 9), (3003, prose(44), "en", "s1", 9), (3003, prose(45), "en", "s1", 9)]
ALL = ROWS + COPIES + LEAKS + AWKWARD


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(ALL, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, int(k < len(GOOD)), 0) for k in range(len(ROWS))], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_run_is_its_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels)
    rows = [r for r in docs.collect() if model.score(np.array([quality.features((r.text or "").encode())]))[0] >= quality.CUTOFF]
    fps = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    own = list(range(len(rows)))
    for _ in range(4):
        own = [min(own[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
    ids = {c: sorted((r.doc_id is None, r.doc_id or 0) for r, o in zip(rows, own, strict=True) if o == c)[0] for c in set(own)}
    block = decontaminate.Items([1], [ITEM])
    clean = collections.Counter()
    import pyarrow as pa

    kept = simhash.one_of_each(quality.keep_good(docs, labels)).collect()
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == collections.Counter(ids.values())
    for r in kept:
        if not block.find(pa.array([r.text or ""])):
            clean[r.doc_id, r.text] += 1
    mixed = mixing.mix(decontaminate.decontaminated(simhash.one_of_each(quality.keep_good(docs, labels)), spark.read.parquet(f"{folder}/benchmark.parquet"))).collect()
    assert collections.Counter((r.doc_id, r.text) for r in mixed) == clean
    want = collections.Counter({(r.doc_id, r.text): int(r.taken / r["size"] + 0.5) for r in mixed if r["size"]})
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_tokenizer())
    encoded = {t: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4") for _, t in want}
    digests = collections.Counter({(k, len(encoded[t]), zlib.crc32(encoded[t].tobytes())): n for (k, t), n in want.items() if n})
    got = pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == digests
    assert sorted(r.start for r in got) == np.cumsum([0, *[r.n_tokens for r in sorted(got, key=lambda r: r.start)[:-1]]]).tolist()


def test_stages_keep_columns_and_decide(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        kept[name] = collections.Counter((r.doc_id, r.text) for r in got.collect())
    rows = collections.Counter((r[0], r[1]) for r in ALL)
    good = set(GOOD)
    assert all(kept["quality classifier"][k, t] for k, t, *_ in ROWS if t in good)
    assert sum(kept["quality classifier"][k, t] for k, t, *_ in ROWS if t not in good) <= 3
    assert not any(kept["SimHash near-dedup"][k, t] for k, t, *_ in COPIES) and all(kept["SimHash near-dedup"][k, t] for k, t, *_ in ROWS if t in good)
    assert sum(kept["SimHash near-dedup"][k, t] for k, t, *_ in AWKWARD) == 7  # null and empty texts are one group, a copy of a document with an id goes
    assert rows - kept["benchmark decontamination"] == collections.Counter((k, t) for k, t, *_ in LEAKS)
    assert set(kept["mixing sources to target weights"]) <= set(rows)


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
