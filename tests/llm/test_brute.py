"""Whole queries against plain Python on the smallest tables; learned queries against held-out labels."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

from tidewheel.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def later_units(units, width):
    """By document: which units a window covers that starts earlier as well; units: (doc_id, sequence) in order."""
    seen, out = set(), {}
    for d, s in units:
        gone = bytearray(len(s))
        for i in range(len(s) - width + 1):
            w = s[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(w)
        out[d] = gone
    return out


def digest(b):
    return hashlib.sha256(b).hexdigest()


def test_suffix_dedup(spark, texts):
    raw = [(d, (t or "").encode()) for d, t in texts]
    gone = later_units(raw, 100)
    want = {d: (len(b), sum(gone[d]), len(re.findall(rb"\x01+", gone[d])), digest(bytes(x for x, g in zip(b, gone[d], strict=True) if not g))) for d, b in raw}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_suffix_dedup"](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_fingerprint_dedup(spark, texts):
    raw = [(d, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in texts]
    gone = later_units(raw, 20)
    want = {d: (len(w), sum(gone[d]), digest(" ".join(x for x, g in zip(w, gone[d], strict=True) if not g).encode())) for d, w in raw}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_fingerprint_dedup"](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_near_duplicates(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    first = {d: d for d in sets}

    def find(d):
        while first[d] != d:
            d = first[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        met = defaultdict(int)
        for x in s:
            for o in holders[x]:
                met[o] += 1
            holders[x].append(d)
        for o, n in met.items():
            if 100 * n >= 85 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(o), find(d)))
                first[b] = a
    want = {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op5_minhash_neardup"](spark, SF).collect()}
    assert got == want and any(not w[2] for w in want.values())


def test_bpe(spark, texts):
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation(), library.no_padding()
    want = {}
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), digest(b"".join(i.to_bytes(4, "little") for i in ids)), digest(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op4_bpe_round_trip"](spark, SF).collect()} == want


def test_held_out_language(spark):
    sf = SF.replace("0.001", "0.01")
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    held = [r for r in QUERIES["op2_language_id"](spark, sf).collect() if r["held_out"] and r["doc_id"] in lang and r["lang_pred"] != "und"]
    assert len(held) > 100 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.01")
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    held = [r for r in QUERIES["op9_quality_gam"](spark, sf).collect() if r["held_out"] and r["doc_id"] in quality]
    good, bad = ([r["score"] for r in held if quality[r["doc_id"]] == q] for q in (1, 0))
    assert good and bad
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in held)


@pytest.mark.parametrize(("share", "split", "block", "hot"), [(512, 8, 4096, 2000), (4, 3, 16, 2000), (4, 8, 5, 6)])
def test_split_clusters(spark, monkeypatch, share, split, block, hot):
    """A chain whose ends are not alike, a large group and a bridge, whatever blocks the candidates fall into."""
    from tidewheel.llm import neardup

    for name, value in (("SHARE", share), ("SPLIT", split), ("BLOCK", block), ("HOT_KEY", hot)):
        monkeypatch.setattr(neardup, name, value)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"n{i}" if i < 3 * j else w for i, w in enumerate(base)) for j in range(40)]
    texts += [" ".join(f"g{i}" for i in range(100)) + f" end{j}" for j in range(30)] + ["alone " * 3, "x y z"]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    low = list(range(len(texts)))
    for _ in low:  # smallest id reachable
        low = [min(low[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 85 * len(a | b)) for a in sets]
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == dict(enumerate(low))
