"""Work that must not be cut: ids of any sign, and indexes of more runs than one."""

import random

import numpy as np
import pytest
from test_brute import digest, later_units

from corpus_pipeline import leaks, near, passages, quality
from tidewheel.llm import neardup
from tidewheel.llm.decontam import contaminated
from tidewheel.llm.fpindex import FingerprintIndex, substring_dedup
from tidewheel.llm.repeats import Units
from tidewheel.llm.suffix import suffix_dedup

LEAST = -(2**63)


def scattered(spark, rows):
    """doc_id, text: each row in a map task (and so a flush) of its own."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def signed():
    """Passages shared by negative, positive and least ids; none is shared inside one map task."""
    rng = random.Random(5)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = [new(40) for _ in range(5)]
    rows = [(-5, f"{new(30)} {p[0]}"), (-3, f"{p[0]} {new(9)}"), (4, f"{p[1]} {new(25)}"), (-9, f"{new(5)} {p[1]}"), (-1, p[2]), (11, f"{new(50)} {p[2]}")]
    return rows + [(LEAST, f"{p[3]} {new(3)}"), (12, f"{new(8)} {p[3]} {p[4]}"), (-(2**40), f"{new(21)} {p[4]}"), (13, new(60))]


def test_suffix_negative_ids(spark, signed):
    raw = [(d, t.encode()) for d, t in sorted(signed)]
    gone = later_units(raw, 100)
    want = {d: (sum(gone[d]), digest(bytes(x for x, g in zip(b, gone[d], strict=True) if not g))) for d, b in raw}
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup(scattered(spark, signed), width=100).collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) == 4


def test_fingerprint_negative_ids(spark, signed):
    raw = [(d, tuple(t.split())) for d, t in sorted(signed)]
    gone = later_units(raw, 20)
    want = {d: (sum(gone[d]), digest(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode())) for d, w in raw}
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup(scattered(spark, signed), width=20).collect()}
    assert got == want and sum(w[0] > 0 for w in want.values()) == 4


@pytest.fixture(scope="module")
def chained():
    """Documents 1 to 40; each holds a passage that returns 3, 11 and 27 ids later."""
    rng = random.Random(6)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    p = {i: new(30) for i in range(1, 41)}
    return [(i, " ".join([new(5), *(p[j] for j in (i, i - 3, i - 11, i - 27) if j in p)])) for i in p]


def test_compacted_index(spark, chained, monkeypatch):
    raw = [(d, tuple(t.split())) for d, t in chained]
    gone = later_units(raw, 20)
    want = {d: (sum(gone[d]), digest(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode())) for d, w in raw}
    merged, compact = [], FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (merged.append(len(self.runs)), compact(self)))
    for more in ({}, {"batches": 8}):
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dedup(spark.createDataFrame(chained, "doc_id bigint, text string"), width=20, **more).collect()}
        assert got == want and sum(w[0] > 0 for w in want.values()) > 30
    assert merged == [4, 4, 4]


def test_reopened_index(spark, chained, tmp_path):
    u, docs = Units("words", 20, 5, "hash"), spark.createDataFrame(chained, "doc_id bigint, text string")
    found = lambda df: sorted(x for r in df.collect() for x in zip(np.frombuffer(r["codes"], "<u8").tolist(), np.frombuffer(r["ids"], "<i8").tolist(), strict=True))
    whole, kept = FingerprintIndex(spark, u, 3, 5), f"file://{tmp_path}/index"
    for i in range(6):  # the fourth batch compacts
        batch = docs.where(f"doc_id div 7 = {i}")
        again = FingerprintIndex(spark, u, 3 if i == 0 else 99, 5, kept)
        a, b = found(whole.ingest(batch)), found(again.ingest(batch))
        assert a == b and (i == 0 or a)
        assert len(again.runs) == len(whole.runs) == (1, 2, 3, 1, 2, 3)[i]
    assert sorted(x.name for x in (tmp_path / "index").glob("run-*")) == [r.rsplit("/", 1)[1] for r in again.runs]
    with pytest.raises(ValueError, match="other units"):
        FingerprintIndex(spark, Units("words", 30, 5, "hash"), 3, 5, kept)


def test_batches_over_two_sessions(spark, chained, tmp_path):
    """Six batches, each with its removals at once, the index opened again for every other one: as one run over all."""
    raw = [(d, tuple(t.split())) for d, t in chained]
    gone = later_units(raw, 20)
    want = {d: (len(w), sum(gone[d]), digest(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode())) for d, w in raw}
    u, docs, path, got, runs = Units("words", 20, 5, "hash"), spark.createDataFrame(chained, "doc_id bigint, text string"), f"file://{tmp_path}/index", {}, []
    for i in range(6):
        index = FingerprintIndex(spark, u, 3, 5, path) if i % 2 == 0 else index
        out = index.add(docs.where(f"doc_id div 7 = {i}"))
        got |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
        runs.append(len(index.runs))
    assert got == want and runs == [1, 2, 3, 1, 2, 3]
    again = FingerprintIndex(spark, u, 3, 5, path)
    with pytest.raises(ValueError, match="follow"):
        again.add(docs.where("doc_id = 3"))
    assert again.add(docs.limit(0)).count() == 0
    late = again.add(docs.where("doc_id = 2").selectExpr("1000 as doc_id", "concat('new words ', text) as text"), keep_text=True).first()
    # old windows cover all words but the new ones
    assert late["n_words"] == want[2][0] + 2 and late["kept_text"] == "new words"


def test_pairs_at_the_threshold(spark):
    """Pairs with a similarity of just 0.80 whose signatures differ in more than 23 of 60 symbols."""
    rng, far = random.Random(7), []
    for _ in range(60):
        pairs = []
        for _ in range(500):
            w = [f"w{rng.randrange(10**9)}" for _ in range(10)]
            pairs.append((" ".join(w[:9]), " ".join(w[1:])))
        data = [t.encode() for p in pairs for t in p]
        h, d = neardup.sets_of(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 1)
        sig = neardup.signatures(h, d, len(data))
        far += [pairs[i] for i in np.flatnonzero((sig[::2] != sig[1::2]).sum(1) > 23)]
    assert far
    out = neardup.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(t for p in far for t in p)], "doc_id bigint, text string"), shingle=1, percent=80)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i - i % 2 for i in range(2 * len(far))}


def test_low_thresholds(spark):
    assert all(neardup.miss_rate(neardup.chunks_for(p), p) <= neardup.MISS for p in range(65, 101))
    with pytest.raises(ValueError, match="too low"):
        neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), percent=60)


def test_stages_judge_rows(spark, tmp_path):
    """Rows without an id, and rows that share one, are judged one by one."""
    rng = random.Random(8)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, a, b, c, clean = new(30), new(60), new(60), new(40), new(80)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, texts):
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(d, t, "en", "a", len(t)) for d, t in texts], 4), "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)

    assert left(leaks, [(None, f"{a} {item}"), (None, clean), (3, f"{item} {b}"), (3, b)]) == sorted([(None, clean), (3, b)], key=repr)
    assert left(quality, [(None, "again " * 50), (None, clean), (3, "too short"), (3, b)]) == sorted([(None, clean), (3, b)], key=repr)
    assert left(near, [(None, a), (None, a), (None, b), (9, b), (7, b), (3, clean), (3, clean)]) == sorted([(None, a), (7, b), (3, clean)], key=repr)
    got = left(passages, [(None, f"{a} {c}"), (None, f"{a} {c}"), (8, f"{b} {clean}"), (-8, clean)])
    assert got == sorted([(None, f"{a} {c}"), (None, ""), (8, f"{b} "), (-8, clean)], key=repr)


def test_crowded_leaks(spark):
    """Documents made of four fifths of each of 400 benchmark items, in other orders."""
    rng = random.Random(9)
    items = [[f"w{rng.randrange(10**6)}" for _ in range(132)] for _ in range(400)]
    texts = [" ".join(" ".join(w[:107]) for w in rng.sample(items, 400)) for _ in range(20)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), table, percent=80).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in got) == [(d, i, 103) for d in range(20) for i in range(400)]
