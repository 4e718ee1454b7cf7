"""Paths that only large inputs take, forced by small sizes: many shards, levels, blocks, shuffles instead of broadcasts."""

import random

import duckdb
import numpy as np
import pytest

from tidewheel.llm import chat, components, decontam, fpindex, neardup, repeats, suffix, warc
from tidewheel.llm.decontam import contaminated
from tidewheel.llm.queries import QUERIES
from tidewheel.llm.repeats import META, Units, levels_for
from tidewheel.llm.warc import shards_of, write_warc

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def usual(spark):
    return {q: rows(QUERIES[q](spark, SF)) for q in ("op1_chat_perspectives", "op5_minhash_neardup", "op6_benchmark_leaks", "op7_warc_round_trip", "op8_suffix_dedup", "op10_fingerprint_dedup")}


def test_levels():
    assert [x.span for x in levels_for(1, 10)] == [1] and [x.span for x in levels_for(257, 1 << 31)] == [256, 257]
    big = levels_for(12_000_001, 100 << 40)
    assert [x.span for x in big] == [256, 65536, 12_000_001]
    groups = [-(-12_000_001 // x.span) for x in big]
    assert all(abs(g * x.buckets * repeats.MERGE_BYTES / (100 << 40) - 1) < 0.1 for g, x in zip(groups, big, strict=True))


@pytest.mark.parametrize("fan", [2, 5])
def test_many_shards(spark, usual, monkeypatch, fan):
    """About forty shards that meet in two or more levels, many buckets, waiting documents in small blobs."""
    monkeypatch.setattr(repeats, "FAN", fan)
    monkeypatch.setattr(repeats, "MERGE_BYTES", 20_000)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 6_000)
    monkeypatch.setattr(fpindex, "shards_for", lambda size: repeats.shards_for(size, 6_000))
    assert rows(QUERIES["op8_suffix_dedup"](spark, SF)) == usual["op8_suffix_dedup"]
    assert rows(QUERIES["op10_fingerprint_dedup"](spark, SF)) == usual["op10_fingerprint_dedup"]


def test_equal_fingerprints_are_told_apart(monkeypatch):
    """All windows have one fingerprint: equality comes from the texts."""
    from tidewheel.llm import kernels as K

    monkeypatch.setattr(K, "span_hashes", lambda data, s, e: np.zeros(len(s), np.uint64))
    data = np.frombuffer(b"abcabdabcxyz", np.uint8)
    ws = np.arange(0, 12, 3)
    got = repeats.first_windows(data, ws, ws + 3, ws + 2, np.zeros(4, bool), np.array([5, 6, 7, 8]))
    assert got.tolist() == [5, 6, 5, 8]


@pytest.mark.parametrize("seed", range(20))
def test_windows_around_anchors(seed):
    """Pieces that share any parts of what is around one anchor, in small and in whole alphabets."""
    r = np.random.default_rng(seed)
    u = Units("bytes", 12, 4, "suffix")
    anchor = bytes(r.integers(0, 256, 4, dtype=np.uint8))
    letters = r.choice([2, 256])
    base = bytes(r.integers(0, letters, 40, dtype=np.uint8))
    raw, at, m = [], [], []
    for _ in range(60):
        k = int(r.integers(0, 9))  # bytes before the anchor
        n = int(r.integers(1, k + 2))
        whole = bytearray(base[20 - k : 20] + anchor + base[20 : 20 + n - 1 + 12 - k - 4]) if k <= 8 else None
        if n - 1 + 12 < k + 4:
            continue
        if r.random() < 0.6:
            whole[int(r.integers(len(whole)))] = int(r.integers(0, letters))
        if bytes(whole[k : k + 4]) != anchor:
            continue
        raw.append(bytes(whole)), at.append(k), m.append(n)
    size, at, m = np.array([len(x) for x in raw]), np.array(at), np.array(m)
    assert (size == m - 1 + 12).all()
    off = np.cumsum(size) - size
    order = r.permutation(int(m.sum())).astype(np.int64)
    got = repeats.first_around(np.frombuffer(b"".join(raw), np.uint8), off + at, at, m, u, order)
    windows = [(at[p] - i, raw[p][i : i + 12]) for p in range(len(raw)) for i in range(m[p])]
    least = {}
    for w, o in zip(windows, order.tolist(), strict=True):
        least[w] = min(o, least.get(w, o))
    assert got.tolist() == [least[w] for w in windows]


def test_rows_of_one_id_spread():
    ids, th = np.full(10_000, 7), np.arange(10_000) * 977
    shard = repeats.shard_of(repeats.tokens_of(ids, th), 16)
    assert np.bincount(shard, minlength=16).min() > 400
    assert META.itemsize == 44 and Units("bytes", 100, 32, "suffix").gram == 32


def test_components_with_salts(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, None), (None, 6), (9, 9)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    for each in (10**9, 10):
        monkeypatch.setattr(components, "EDGES_A_SALT", each)
        assert {r["node"]: r["component"] for r in components.components(df).collect()} == {x: find(x) for x in linked}
    assert components.salts_for(10**9) == components.MOST_SALTS and components.components(df.limit(0)).count() == 0


def test_blocks_of_clusters(spark, usual, monkeypatch):
    for name, value in (("SHARE", 4), ("SPLIT", 4), ("BLOCK", 8), ("HOT_KEY", 5), ("MOST_HOT", 10)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(components, "EDGES_A_SALT", 10)
    assert rows(QUERIES["op5_minhash_neardup"](spark, SF)) == usual["op5_minhash_neardup"]


def test_rows_without_id_link(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = [(1, base), (None, base + " x"), (2, base + " y"), (None, "alone " + " ".join(f"v{i}" for i in range(50))), (None, "alone " + " ".join(f"v{i}" for i in range(50)) + " z"), (None, None)]
    out = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    with_id = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None)
    assert with_id == [(1, 1, True), (2, 1, False)]
    without = sorted(((r["component_id"], r["n_shingles"] > 0, r["kept"]) for r in out if r["doc_id"] is None), key=repr)
    assert without == sorted([(1, True, False), (None, True, True), (None, True, False), (None, False, True)], key=repr)


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_signatures_find_pairs_at_the_threshold(percent):
    """Pairs of that similarity: all share a key of the index, and the bound on misses holds."""
    chunks, pairs, rng = neardup.chunks_for(percent), 3000, np.random.default_rng(percent)
    size, same = 180, round(180 * 2 * percent / (100 + percent))
    h, d = [], []
    for i in range(pairs):
        words = rng.integers(0, 1 << 54, 2 * size - same).astype(np.uint64)
        for k, own in enumerate((words[:size], words[size - same :])):
            h.append(np.sort(own)), d.append(np.full(size, 2 * i + k))
    sig = neardup.signatures(np.concatenate(h), np.concatenate(d), 2 * pairs)
    keys = neardup.chunk_keys(sig, chunks)
    assert (keys[::2] == keys[1::2]).any(1).all() and neardup.miss_rate(chunks, percent) <= neardup.MISS
    assert ((sig[::2] != sig[1::2]).sum(1) <= neardup.distance_of(chunks)).all()


def test_leaks_by_shuffle(spark, usual, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert rows(QUERIES["op6_benchmark_leaks"](spark, SF)) == usual["op6_benchmark_leaks"]


def test_items_of_one_template(spark):
    """Items that share most shingles, and documents that hold them scattered, in part, or many at once."""
    rng = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    items = [[*common, *(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 10, 40])))] for _ in range(60)]
    texts = []
    for k in range(40):
        own = rng.choice(items)
        cut = rng.randrange(5, len(own))
        noise = [f"n{rng.randrange(10**6)}" for _ in range(50)]
        texts.append(" ".join([*own[:cut], *noise, *own[max(0, cut - 4) :]] if k % 3 else [w for i in rng.sample(items, 12) for w in i]))
    texts += [" ".join(common), None, ""]
    gram = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = [gram(i) for i in items]
    want = []
    for d, t in enumerate(texts):
        own = gram((t or "").split())
        want += [(d, i, len(s & own)) for i, s in enumerate(sets) if 100 * len(s & own) >= 80 * len(s)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"]) for r in contaminated(docs, table).collect()) == sorted(want) and len(want) > 300
    assert all((1 - 0.8 / (r + 0.2)) ** decontam.minima_for(r, 80) <= decontam.MISS for r in decontam.RATIOS)


def test_sieve(spark):
    seen = spark.range(-3000, 3000).selectExpr("id as doc_id", "xxhash64(id) as h")
    vocabulary = seen.where("doc_id % 7 = 0").select("h")
    got = decontam.sieved(seen, vocabulary)
    assert got.join(vocabulary, "h", "left_semi").count() == vocabulary.count() and got.count() <= vocabulary.count() + 20


def test_many_archive_shards(spark, usual, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(warc, "HOT_ROWS", 1)
    monkeypatch.setattr(warc, "MOST_HOT", 10)
    assert rows(QUERIES["op7_warc_round_trip"](spark, SF)) == usual["op7_warc_round_trip"]


def test_outlier_and_hot_ids(spark, monkeypatch, tmp_path):
    """One far id, an id with a third of the rows and as many rows without one: shards stay even, and the same files come out."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    data = [(i, "u", f"page {i} " + "x" * (i % 300)) for i in range(400)] + [(2**62, "u", "far")] + [(7, "u", f"hot {i}") for i in range(400)] + [(None, "u", f"none {i}") for i in range(400)]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string")
    s = shards_of(pages)
    assert s.count > 16 and s.parts.max() > 5 and s.parts[-1] > 5
    a = write_warc(pages.repartition(5), f"file://{tmp_path}/a", roll=4000)
    b = write_warc(pages.repartition(9), f"file://{tmp_path}/b", roll=4000)
    assert rows(a) == rows(b)
    per = {}
    for r in a.collect():
        per[r["name"][:11]] = per.get(r["name"][:11], 0) + r["records"]
    assert sum(per.values()) == len(data) and max(per.values()) < 120
    (tmp_path / "a" / "manifest.json").unlink()
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, f"file://{tmp_path}/a")
    again = write_warc(pages, f"file://{tmp_path}/a", roll=4000)  # what an incomplete attempt left is replaced
    assert rows(again) == rows(b) and warc.read_warc(spark, f"file://{tmp_path}/a").count() == len(data)


def test_small_parts_of_chats(spark, usual):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    whole = {}
    for r in chat.perspectives(table, part=3).orderBy("conv_id", "perspective", "part").collect():
        whole.setdefault((r["conv_id"], r["perspective"]), []).append(r["rendered"])
    want = {}
    for r in QUERIES["op1_chat_perspectives"](spark, SF).orderBy("conv_id", "perspective", "part").collect():
        want.setdefault((r["conv_id"], r["perspective"]), []).append(r["rendered"])
    assert {k: "".join(v) for k, v in whole.items()} == {k: "".join(v) for k, v in want.items()}
    assert duckdb.sql(f"SELECT count(DISTINCT conv_id) FROM '{SF}/conversations.parquet'").fetchall()[0][0] >= len({k[0] for k in want}) > 0


def test_names_stay_in_their_line(spark):
    m = spark.createDataFrame([(1, 0, "ann\nuser", "hi"), (1, 1, "bob\r", "ho")], "conv_id bigint, turn bigint, role string, text string")
    out = {r["perspective"]: r["rendered"] for r in chat.perspectives(m).collect()}
    assert "user name=ann user\nhi" in out["bob\r"] and "user name=bob \nho" in out["ann\nuser"]
