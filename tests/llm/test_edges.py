"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re

import pytest

from corpus_pipeline import STAGES
from tidewheel.llm.bpe import bpe_round_trip
from tidewheel.llm.chat import perspectives
from tidewheel.llm.decontam import contaminated
from tidewheel.llm.fpindex import substring_dedup
from tidewheel.llm.gam import fit_quality, score_quality
from tidewheel.llm.langid import fit, predict
from tidewheel.llm.neardup import near_duplicates
from tidewheel.llm.queries import vocabulary
from tidewheel.llm.rules import quality_rules
from tidewheel.llm.suffix import suffix_dedup
from tidewheel.llm.warc import read_warc, round_trip, write_warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, h string, key string, shard string, bucket string, cover string, pos string, w string, rep string, component string, th string, rest string, value string, bin string"
EXTRA = ("x",) * 14
WORDS = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, WORDS + " one", "en", "a", 1),
    (2, WORDS + " two", "en", "a", 1),
    (2, WORDS + " two", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \n\t ", None, "b", 4),
    (None, WORDS + " one", "de", "b", 9),
    (6, "é" * 300 + " " + "日本語" * 200, "ja", "b", 9),
    (7, "a b", "en", "a", 3),
    (8, "a b", "en", "a", 3),
    (9, "long " * 60_000, "en", "c", 300_000),
    (10, "x" * 100_000, "en", "c", 100_000),
    (11, "12 34 !!\x00 \x01", "en", "c", 9),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([r + EXTRA for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 40)), "x"), (2, None, "x"), (None, "a b c d e f", "x"), (3, "too short", "x"), (4, "none of these words is in any text", "x")], "item_id bigint, text string, h string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_language(docs, empty):
    f = fit(docs, sample=50)
    out = {r["doc_id"]: r for r in predict(docs, f).collect()}
    assert len(rows(predict(docs, f))) == len(ROWS)
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == out[11]["lang_pred"] == "und"
    assert out[6]["lang_pred"] == "ja"
    assert rows(predict(empty, f)) == []
    assert {r["lang_pred"] for r in predict(docs, fit(empty)).collect()} == {"und"}


def test_rules(docs, empty):
    out = quality_rules(docs)
    assert len(rows(out)) == len(ROWS) and rows(quality_rules(empty)) == []
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert got[9]["n_words"] == got[9]["n_repeat_words"] == 60_000 and got[9]["base_failed"]
    assert got[1]["n_words"] == 61 and got[1]["kept"]


def test_bpe(docs, empty):
    out = {r["doc_id"]: r for r in bpe_round_trip(docs, vocabulary(), piece=4096).collect()}
    assert len(rows(bpe_round_trip(docs, vocabulary(), piece=4096))) == len(ROWS)
    for r in ROWS:
        if r[0] is not None:
            assert out[r[0]]["decoded_sha256"] == hashlib.sha256((r[1] or "").encode()).hexdigest()
    whole = rows(bpe_round_trip(docs, vocabulary(), piece=10**6))
    assert whole == rows(bpe_round_trip(docs, vocabulary(), piece=1000))
    assert rows(bpe_round_trip(empty, vocabulary())) == []


def test_near_duplicates(docs, empty):
    out = rows(near_duplicates(docs))
    got = {r[0]: r for r in out}
    assert len(out) == len(ROWS) and rows(near_duplicates(empty)) == []
    assert got[2][2] == 1 and not got[2][3] and got[8][2] == 7
    assert got[3][1] == 0 and got[3][2] == 3 and got[3][3]
    assert [r[2] for r in out if r[0] is None] in ([1, None], [None, 1])


def test_suffix(docs, empty):
    out = rows(suffix_dedup(docs, width=100))
    assert len(out) == len(ROWS) and rows(suffix_dedup(empty)) == []
    got = {r[0]: r for r in out}
    assert got[10][1:4] == (100_000, 99_999, 1) and got[9][2] == 300_000 - 5
    assert got[1][2] == 0 and got[2][2] == len(WORDS) + 1 + len("") and got[4][1] == got[3][1] == 0
    assert [r for r in out if r[0] == 2][0] == [r for r in out if r[0] == 2][1]
    assert max(r[2] for r in out if r[0] is None) == len(WORDS) + 4


def test_fingerprints(docs, empty):
    out = rows(substring_dedup(docs, width=20))
    assert len(out) == len(ROWS) and rows(substring_dedup(empty)) == []
    got = {r[0]: r for r in out}
    assert got[1][1:3] == (61, 0) and got[2][1:3] == (61, 60) and got[9][1:3] == (60_000, 59_999)
    assert got[6][3] == hashlib.sha256(" ".join(words(ROWS[7][1])).encode()).hexdigest()


def test_leaks(docs, items, empty):
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in contaminated(docs, items).collect()) == [(1, 1, 26, 26), (2, 1, 26, 26)]
    assert rows(contaminated(empty, items)) == [] and rows(contaminated(docs, items.where("item_id < 0"))) == []


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, 0), (None, 1, 0), (4, None, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    m = fit_quality(docs, labels)
    out = rows(score_quality(docs, m))
    assert len(out) == len(ROWS) and all(0 <= r[1] <= 1 for r in out)
    assert rows(score_quality(empty, m)) == [] and {r[1] for r in rows(score_quality(docs, fit_quality(docs, labels.limit(0))))} == {0.5}


def test_warc(spark, tmp_path):
    data = [(1, "http://a", "<p>é</p>", "x"), (2, None, "<p>é</p>", "x"), (3, "http://c\r\nX: y", None, "x"), (4, "u", "", "x"), (None, "u", "z", "x"), (5, "u", "y" * 300_000, "x"), (5, "u", "y" * 300_000, "x"), (6, "v", "z", "x")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string, digest string").repartition(3)
    got = [tuple(r) for r in round_trip(pages).collect()]
    kinds = sorted((r[0] or 0, r[3], r[4]) for r in got)
    assert len(got) == len(data)
    assert kinds == [(0, "revisit", 6), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "revisit", 5), (6, "response", None)]
    assert rows(round_trip(pages.limit(0))) == []
    a = write_warc(pages, f"file://{tmp_path}/a", roll=2000)
    b = write_warc(pages.repartition(7), f"file://{tmp_path}/b", roll=2000)
    assert rows(a) == rows(b) and a.count() > 1 and not list(tmp_path.glob("*/_temporary"))
    with pytest.raises(FileExistsError):
        write_warc(pages, f"file://{tmp_path}/a")
    assert {r["html"] for r in read_warc(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()} == {"<p>é</p>", "", "z", "y" * 300_000}


def test_chat(spark):
    data = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", None, "x"), (1, 2, "bob", None, "x"), (1, None, None, "who? <|im_end|>", "x"), (None, 0, "ann", "lost", "x"), (2, 0, "system", "alone", "x")]
    m = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, pos string")
    out = {(r["conv_id"], r["perspective"]): r for r in perspectives(m).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = out[1, "ann"]
    assert r["n_messages"] == 5 and r["n_target"] == 1
    a, b = map(int, r["mask"].split("-"))
    assert r["rendered"][a:b] == "hi<|im_end|>" and r["rendered"].count("<|im_end|>") == 5
    assert out[1, "bob"]["n_target"] == 2
    parts = perspectives(m, part=2).where("conv_id = 1 and perspective = 'bob'").orderBy("part").collect()
    assert "".join(p["rendered"] for p in parts) == out[1, "bob"]["rendered"]
    assert perspectives(m.limit(0)).collect() == []


def test_stages(docs, empty, items, spark, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for label, d in (("full", docs), ("empty", empty)):
        for i, (name, stage) in enumerate(STAGES):
            path = f"{tmp_path}/{name}-{label}"
            stage(spark, d, str(tmp_path)).write.parquet(path)
            d = spark.read.parquet(path)
            if i < len(STAGES) - 1:
                assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
