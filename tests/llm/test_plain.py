"""Learned scores, samples and the whole pipeline against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_brute import later_units
from tokenizers import Tokenizer

import corpus_pipeline
from tidewheel.llm import gam, langid
from tidewheel.llm.pipeline import STAGES
from tidewheel.llm.queries import QUERIES, fold, table, vocabulary
from tidewheel.llm.sample import ALL, least_hashed, threshold
from tidewheel.llm.sql import RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_thresholds():
    """About 2 * most + 20 rows at any size of the table; never none."""
    for n in (10**6, 10**9, 10**12, 10**15):
        for most in (800, 20_000):
            share = (threshold(n, most) + 2**63) / 2**64
            assert share * n == pytest.approx(2 * most + 20, rel=1e-6)
    assert threshold(1000, 800) == ALL


def test_bounded_sample(spark):
    from pyspark.sql import functions as F

    t = spark.range(50_000).selectExpr("id", "if(id % 100 = 0, 'b', 'a') as g", "cast(id as string) as text")
    t = t.unionByName(t.where("id < 20000").selectExpr("7 as id", "'a' as g", "'same' as text"))
    n = {r["g"]: r["count"] for r in least_hashed(t, F.xxhash64("id"), 300, "g").groupBy("g").count().collect()}
    assert n == {"a": 300, "b": 300}
    again = [sorted(r["text"] for r in least_hashed(x, F.xxhash64("id"), 300, "g").collect()) for x in (t, t.repartition(7))]
    assert again[0] == again[1] and again[0].count("same") <= 1


def plain_grams(text):
    """4-grams of the text's bytes: letters lower, other ASCII a space, none with two spaces in a row."""
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]


def test_language_scores(spark, documents):
    docs = table(spark, SF, "documents")
    filters = langid.fit(docs.where(~fold(4, 2)))
    held = {r["doc_id"] for r in docs.where(fold(4, 2)).select("doc_id").collect()}
    names = sorted({d[2] for d in documents if d[2] is not None})
    assert filters.languages == names
    seen = [d for d in documents if d[0] not in held and d[1] and d[2] is not None]
    bits = np.zeros((len(names), langid.SLOTS), bool)
    for k, name in enumerate(names):
        own = [d for d in seen if d[2] == name]
        n = Counter(g for d in own for g in set(plain_grams(d[1])))
        least = 1 if len(own) < langid.FEW else langid.LEAST_DOCS
        for g in (g for g, c in n.items() if c >= least):
            for s in langid.slots_of(np.array([int.from_bytes(g, "big")], np.uint32), langid.SLOTS):
                bits[k, s[0]] = True
    chance = [(bits[k].sum() / langid.SLOTS) ** langid.HASHES for k in range(len(names))]
    want = {}
    for d, text, *_ in documents:
        if not text or not any(c.isalpha() for c in text):
            want[d] = ("und", 0.0)
            continue
        g = plain_grams(text)
        places = langid.slots_of(np.array([int.from_bytes(x, "big") for x in g], np.uint32), langid.SLOTS)
        share = [sum(all(bits[k, s[i]] for s in places) for i in range(len(g))) / max(1, len(g)) for k in range(len(names))]
        score = [min(1.0, max(0.0, (x - c) / (1 - c + 1e-12))) for x, c in zip(share, chance, strict=True)]
        best = max(range(len(names)), key=lambda k: (score[k], -k))
        want[d] = (names[best], score[best] / max(sum(score), 1e-12))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in QUERIES["op2_language_id"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == w[0] and got[d][1] == pytest.approx(w[1], abs=1e-9) for d, w in want.items())


def plain_features(text):
    b = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, size = max(1, len(w)), max(1, len(b))
    chars = sum(len(x.decode("utf-8", "replace")) for x in w)
    lines = [x for x in b.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    count = lambda s: sum(c in s for c in b)
    return [
        math.log1p(len(w)), chars / n, count(b"#*$%&|<>") / n, (len(lines) - len(set(lines))) / n, len(again) / n, len(set(w)) / n,
        count(bytes(range(65, 91))) / size, count(b"0123456789") / size, count(b".") / n, count(b"!?") / n, count(b"|") / n, count(b"\n") / n,
        sum(c >= 128 for c in b) / size, math.log1p(max(map(len, w), default=0)),
    ]


def test_quality_scores(spark, documents):
    """Scores are the sums of table entries, looked up one by one; pairs take part."""
    docs = table(spark, SF, "documents")
    m = gam.fit_quality(docs, table(spark, SF, "labels").where(~fold(5, 0)))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in QUERIES["op9_quality_gam"](spark, SF).collect()}
    assert len(m.pairs) == gam.PAIRS
    for d, text, *_ in documents:
        x = plain_features(text or "")
        bins = [sum(e < v for e in m.edges[i]) for i, v in enumerate(x)]
        f = m.intercept + sum(m.tables[i][k] for i, k in enumerate(bins))
        f += sum(t[int(m.coarse[i][bins[i]]) * gam.PAIR_BINS + int(m.coarse[j][bins[j]])] for i, j, t in m.pairs)
        score = 1 / (1 + math.exp(-f))
        assert got[d] == (pytest.approx(score, abs=1e-9), int(score >= 0.3)), d


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = gam.AdditiveModel().fit(x[:3000], y[:3000])
    right = ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    m.pairs = []
    assert right > 0.85 > 0.65 > ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()


def test_pair_tree_is_the_best_first_cut():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 8, 500), r.integers(0, 8, 500)
    g = np.where(b > 4, 1.0, -1.0) + 0.1 * r.normal(size=500)
    t = gam.shallow_pair(a * 8 + b, g, np.ones(500), 8, splits=1).reshape(8, 8)
    assert (t[:, :5] == t[0, 0]).all() and (t[:, 5:] == t[0, 7]).all() and t[0, 0] < 0 < t[0, 7]


# ---- the pipeline -------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def plain_near(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {d: shingles((t or "").translate(lower), 5) for d, t in docs}
    root, holders = {d: d for d in sets}, defaultdict(list)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        met = Counter(o for x in s for o in holders[x])
        for x in s:
            holders[x].append(d)
        for o, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                root[b] = a
    return [(d, t) for d, t in docs if find(d) == d]


def plain_passages(docs):
    raw = [(d, (t or "").encode()) for d, t in docs]
    gone = later_units(raw, 100)
    return [(d, bytes(x for x, g in zip(b, gone[d], strict=True) if not g).decode("utf-8", "ignore")) for d, b in raw]


def plain_leaks(docs, items):
    gram = lambda t: {tuple(w[i : i + 5]) for w in [words(t.lower())] for i in range(len(w) - 4)}
    sets = [s for s in (gram(t) for _, t in items if t) if s]
    return [(d, t) for d, t in docs if not any(100 * len(s & own) >= 80 * len(s) for own in [gram(t)] for s in sets)]


def test_pipeline(spark, tmp_path):
    """Every stage's documents, ids and texts, and the last one's tokens."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({RULES}) WHERE kept").fetchall()}
    docs = [x for x in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if x[0] in kept]
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = [docs]
    for step in (plain_near, plain_passages, lambda d: plain_leaks(d, items)):
        want.append(step(want[-1]))
    assert len(want[0]) > len(want[1]) >= len(want[3])
    at = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted((r["doc_id"], r["text"]) for r in at.collect()) == want[i], name
        if name == "repeated_passages":
            assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    library = Tokenizer.from_file(vocabulary())
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in want[3]}
    out = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()}
    blob = {d: b"".join(i.to_bytes(4, "little") for i in x) for d, x in ids.items()}
    assert out == {d: (len(x), hashlib.sha256(blob[d]).hexdigest(), blob[d]) for d, x in ids.items()}
