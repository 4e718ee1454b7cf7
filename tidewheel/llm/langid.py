"""Language identification with bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.sample import least_hashed
from tidewheel.llm.store import discard, written

#: labelled documents used for fitting, per language, at most
SAMPLE = 800
MOST_LANGUAGES = 4096
#: slots of the filter (a power of two); each holds one bit for each language
SLOTS = 1 << 18
HASHES = 2
#: bytes of an n-gram
GRAM = 4
#: an n-gram belongs to a language if it is in at least this many of its sample documents, or in one if the sample has fewer than FEW
LEAST_DOCS, FEW = 3, 50


def letters_table() -> np.ndarray:
    """Lower-case ASCII letters and all bytes of longer code points stand for themselves, other bytes for a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams that begin and end inside a text and hold no two spaces in a row; their documents."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    x = letters_table()[data]
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | x[j : j + n]
    space = x == 32
    twice = space[:-1] & space[1:]
    ok = np.ones(n, bool)
    for j in range(GRAM - 1):
        ok &= ~twice[j : j + n]
    edge = np.zeros(n + GRAM, np.int64)
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - GRAM + 1), 1)
    np.add.at(edge, np.minimum(offsets[1:], len(edge) - 1), -1)
    ok &= np.cumsum(edge)[:n] == 0
    at = np.flatnonzero(ok)
    return code[at], np.searchsorted(offsets, at, "right") - 1


def slots_of(code: np.ndarray, slots: int) -> list[np.ndarray]:
    h = K.mix(code.astype(K.U64) + K.U64(0x632BE59BD9B4E019))
    return [((h >> K.U64(32 * i)) & K.U64(slots - 1)).astype(np.int64) for i in range(HASHES)]


class LanguageFilters:
    """For each slot a bit mask of languages; an n-gram's languages are the AND over its slots."""

    def __init__(self, languages: list[str], slots: int = SLOTS):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.mask = np.zeros((self.words, slots), K.U64)

    def add(self, language: int, codes: np.ndarray) -> None:
        word, bit = divmod(language, 64)
        for s in slots_of(codes, self.mask.shape[1]):
            np.bitwise_or.at(self.mask[word], s, K.U64(1 << bit))

    def fill(self) -> np.ndarray:
        """Share of n-grams that a language's filter holds by chance."""
        rates = [np.count_nonzero((self.mask[i // 64] >> K.U64(i % 64)) & K.U64(1)) / self.mask.shape[1] for i in range(len(self.languages))]
        return np.array(rates) ** HASHES

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """documents x languages: share of n-grams held, corrected for false positives."""
        n = len(offsets) - 1
        code, doc = grams(data, offsets)
        total = np.bincount(doc, minlength=n)
        out = np.zeros((n, len(self.languages)))
        chance = self.fill()
        where = slots_of(code, self.mask.shape[1])
        begin = np.searchsorted(doc, np.arange(n + 1))
        for word in range(self.words):
            hit = self.mask[word][where[0]]
            for s in where[1:]:
                hit &= self.mask[word][s]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                count = np.zeros(len(code) + 1, np.int64)
                np.cumsum((hit >> K.U64(i % 64)) & K.U64(1), out=count[1:], dtype=np.int64)
                share = (count[begin[1:]] - count[begin[:-1]]) / np.maximum(total, 1)
                out[:, i] = np.clip((share - chance[i]) / (1 - chance[i] + 1e-12), 0, 1)
        return out


def fit(labelled: DataFrame, sample: int = SAMPLE, slots: int = SLOTS) -> LanguageFilters:
    """Filters of all languages in labelled (doc_id, text, lang; nulls are left out).

    Of each language `sample` documents are read at most, those with the least
    64-bit hash of their id; rows that share an id count as one of them (rows without
    an id count by their text).  An n-gram is a language's if LEAST_DOCS of the sample
    have it, or one in a language with fewer than FEW documents in the sample.  An
    empty table gives filters without languages; other columns are ignored.
    """
    seen = labelled.where("lang is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    names = sorted(r[0] for r in seen.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    filters = LanguageFilters(names, slots)
    if not names:
        return filters
    own = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    picked = written(least_hashed(seen, own, sample, "lang"), "language-sample")
    sizes = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = {k: i for i, k in enumerate(names)}

    def codes(batches):
        for rows, data, offsets in K.blocks(batches):
            code, doc = grams(data, offsets)
            lang = np.array([place[x] for x in rows.column(1).to_pylist()], np.int64)
            # each n-gram once a document: document above, code below
            once = np.unique((doc.astype(K.U64) << K.U64(32)) | code)
            key = (lang[(once >> K.U64(32)).astype(np.int64)].astype(K.U64) << K.U64(32)) | (once & K.U64(0xFFFFFFFF))
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    found = picked.select("text", "lang").mapInArrow(codes, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    least = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(i), F.lit(1 if sizes[k] < FEW else LEAST_DOCS))])
    kept = found.where(F.col("n") >= F.element_at(least, F.shiftrightunsigned("key", 32).cast("int"))).select("key").toArrow()
    keys = kept.column("key").to_numpy().view(K.U64)
    for i in range(len(names)):
        filters.add(i, (keys[(keys >> K.U64(32)) == i] & K.U64(0xFFFFFFFF)).astype(np.uint32))
    discard(picked)
    return filters


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    found = K.counts_between(ascii_letter[data], offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, filters: LanguageFilters, unknown: str = "und") -> DataFrame:
    """doc_id, lang_pred and score (the winner's part of the sum of all languages' shares) of each whole text.

    `unknown` with score 0 where the text is null or has no letter.  A text with no
    known n-gram gets the first language with score 0; ties go to the language
    that sorts first.  Every row is scored by its text alone: repeated rows and null
    ids give a row each, other columns are ignored, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS words: fixed

    def run(batches):
        f = held.value
        for rows, data, offsets in K.blocks(batches):
            n = len(offsets) - 1
            lettered = has_letter(data, offsets)
            if f.languages:
                s = f.scores(data, offsets)
                best = s.argmax(1)
                score = s[np.arange(n), best] / np.maximum(s.sum(1), 1e-12)
                names = [f.languages[b] if ok else unknown for b, ok in zip(best, lettered, strict=True)]
            else:
                score, names = np.zeros(n), [unknown] * n
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
