"""Removal of passages that repeat across a corpus: the parts that suffix.py and fpindex.py share.

A *unit* is a byte or a word; a *window* is `width` consecutive units of one
document.  Each window's *anchor* is the unit k-gram in it with the least hash
(leftmost on ties), so equal windows have equal anchors.  Anchors are sparse
(about 2 / (width - k + 2) of all units), which is what makes the corpus-wide
part small:

1. candidates: anchors whose hash occurs more than once (suffix.py and fpindex.py
   find them in their own ways);
2. shards: documents meet their candidate anchors; windows at candidate anchors
   are compared inside the shard, and the first of each is sent on;
3. merge: first windows of neighbouring shards meet by anchor and are compared
   exactly (bytes by sorted suffixes and prefixes around their anchors, words by
   fingerprints and then texts); the first ones go on to the next level, where groups of FAN times as
   many shards meet, until all have met;
4. finish: each document's removed units are put together.

Only the first copy in a shard travels, so a passage in a third of all documents
brings FAN copies into one task at most, at any level.  Order is (doc_id, start);
null ids come last, and rows with one id are the same document given more than once:
none is earlier.  A row is named by its token, a mix of its id and its text's hash,
so rows that share an id (or have none) spread over the shards like others do.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.store import parts_for, written

LAST = np.iinfo(np.int64).max
#: shards that meet in a task of the first level of the merge, and groups of them in one of the next
FAN = 256
#: text that meets in a task of the merge, about
MERGE_BYTES = 4 << 20
#: in place of an anchor's document: the anchor is known to repeat.  A document that has this number as its token
#: counts as known everywhere, and its codes are sent at once
KNOWN = np.iinfo(np.int64).min
U64 = K.U64


@dataclass(frozen=True)
class Units:
    """What is counted: bytes or words, the window's width, the anchor's length and the local method."""

    kind: str
    width: int
    gram: int
    local: str  # "suffix" or "hash"


def carried(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, text (null: empty) and rest: the named columns as JSON."""
    rest = F.to_json(F.struct(*columns)) if columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), rest.alias("rest"))


def units_of(u: Units, data: np.ndarray, offsets: np.ndarray):
    """(k-gram hashes by unit, unit offsets of the documents, byte starts and ends of words or None)."""
    if u.kind == "bytes":
        h, have = data.astype(U64) + U64(1), 1
        p = U64(K.BASE)
        while have < u.gram:  # gram is a power of two
            h = h[:-have] * p + h[have:] if len(h) > have else h[:0]
            p = U64(int(p) * int(p) & (2**64 - 1))
            have *= 2
        return K.mix(h), offsets, None
    starts, ends, doc = K.spans(data, offsets)
    h = K.shingles(K.span_hashes(data, starts, ends), u.gram)
    return h, np.searchsorted(doc, np.arange(len(offsets))), (starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: have - w], x[w - have :]) if w > have else x


def anchor_runs(u: Units, h: np.ndarray, uoff: np.ndarray):
    """Maximal runs of windows with one anchor: (first window, windows, anchor hash, document, units from the first window's start to the anchor)."""
    total, w = int(uoff[-1]), u.width
    none = np.zeros(0, np.int64)
    if total < w:
        return none, none, none.astype(U64), none, none
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    at = (sliding_min(key, w - u.gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, np.maximum(uoff[:-1], uoff[1:] - w + 1), 1)
    np.add.at(edge, uoff[1:], -1)
    valid = np.cumsum(edge)[: len(at)] == 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(begins)
    if not len(lo):
        return none, none, none.astype(U64), none, none
    c = np.concatenate([[0], np.cumsum(valid)])
    n = c[np.append(lo[1:], len(at))] - c[lo]
    return lo, n, h[at[lo]], np.searchsorted(uoff, lo, "right") - 1, at[lo] - lo


def code_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket (high half) and 32-bit fingerprint in it (low half); buckets grow with the corpus."""
    return (((h >> U64(32)) % U64(buckets)) << U64(32)) | (h & U64(0xFFFFFFFF))


def ids_of(column) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null(LAST).to_numpy(zero_copy_only=False)


def tokens_of(ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The tokens of rows, from their ids and the hashes of their texts."""
    return K.mix(ids.astype(np.int64).view(U64) ^ K.mix(th.astype(np.int64).view(U64))).view(np.int64)


def shard_of(tokens: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a row."""
    return (tokens.view(U64) % U64(shards)).astype(np.int64)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, th, text: what anchor_rows takes."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def shards_for(size: int, each: int = 8 << 20) -> int:
    return parts_for(size, each) | 1


def anchor_rows(u: Units, buckets: int, shards: int, flush: int = 1 << 20):
    """Map documents to (bucket, fingerprints, ids): one entry for each anchor hash of up to `flush` anchors; ids are tokens.

    An anchor met more than once here is known to repeat: its documents and codes
    go to rows with their shard at once, and its entry carries the id KNOWN.
    """

    def out(codes, ids):
        order = np.lexsort((ids, codes))
        c, d = codes[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        known = np.repeat(size > 1, size) | (d == KNOWN)
        yield from code_rows(c[known], d[known])
        code, owner = c[first], np.where(size > 1, KNOWN, d[first])
        b = (code >> U64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
        fp = (code & U64(0xFFFFFFFF)).astype("<u4")
        if len(b):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b[cuts[:-1]].astype(np.int32)),
                    pa.nulls(len(cuts) - 1, pa.int32()),
                    pa.array([fp[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.array([owner[i:j].astype("<i8").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                ],
                ["bucket", "shard", "codes", "ids"],
            )

    def code_rows(c, d):
        for b in packed_codes(c, d, shards):
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int32()), *b.columns], ["bucket", "shard", "codes", "ids"])

    def run(batches):
        codes, ids, held = [], [], 0
        for rows, data, offsets in K.blocks(batches):
            h, uoff, _ = units_of(u, data, offsets)
            _, _, a, doc, _ = anchor_runs(u, h, uoff)
            codes.append(code_of(a, buckets))
            ids.append(tokens_of(ids_of(rows.column(0)), rows.column(1).to_numpy())[doc])
            held += len(a)
            if held >= flush:
                yield from out(np.concatenate(codes), np.concatenate(ids))
                codes, ids, held = [], [], 0
                K.trim()
        if held:
            yield from out(np.concatenate(codes), np.concatenate(ids))
        del codes, ids
        K.trim()

    return run


ANCHOR_SCHEMA = "bucket int, shard int, codes binary, ids binary"


def packed_codes(codes: np.ndarray, ids: np.ndarray, shards: int):
    """Rows (shard, codes as 64-bit integers, ids), one for each shard."""
    if not len(codes):
        return
    shard = shard_of(ids, shards)
    order = np.argsort(shard, kind="stable")
    c, d, p = codes[order].astype("<u8"), ids[order].astype("<i8"), shard[order]
    cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
    span = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    yield pa.RecordBatch.from_arrays(
        [pa.array(p[cuts[:-1]].astype(np.int32)), pa.array([c[i:j].tobytes() for i, j in span], pa.binary()), pa.array([d[i:j].tobytes() for i, j in span], pa.binary())],
        ["shard", "codes", "ids"],
    )


CODES = "shard int, codes binary, ids binary"
NO_CODES = {"shard": pa.array([], pa.int32()), "codes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())}


def packed(raw: bytes) -> bytes:
    """Size and compressed bytes: what is sent costs less than its compression."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)


#: documents travel as compressed record batches: far fewer bytes on disk than as rows
DOC = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("text", pa.large_string()), ("rest", pa.large_string()), ("cover", pa.large_binary())])
PACK = "shard int, pack binary, codes binary, ids binary"


def bundled(rows: pa.Table) -> bytes:
    """Rows of DOC as one blob."""
    return packed(pa.concat_batches(rows.to_batches()).serialize().to_pybytes())


def unbundled(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(unpacked(raw)), DOC)


def doc_rows(shards: int):
    """Map documents to rows with their shard and those of its documents that came in one Arrow batch."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            docs = pa.Table.from_batches([b]).append_column("cover", pa.nulls(b.num_rows, pa.large_binary())).select(DOC.names).cast(DOC)
            shard = shard_of(tokens_of(ids_of(docs.column("doc_id")), docs.column("th").to_numpy()), shards)
            order = np.argsort(shard, kind="stable")
            p = shard[order]
            cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1], [True]]))
            packs = [bundled(docs.take(pa.array(order[i:j]))) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            none = pa.nulls(len(packs), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(p[cuts[:-1]].astype(np.int32)), pa.array(packs, pa.binary()), none, none], ["shard", "pack", "codes", "ids"])
        K.trim()

    return run


def suffix_groups(seg: np.ndarray, width: int):
    """Suffix array of the bytes and, by place in it, the prefix length (up to `width`) shared with the suffix before.

    Larsson-Sadakane: suffixes sorted by 8 bytes, then every group that is not
    single yet is sorted by the rank at twice the depth, until the depth reaches
    `width`.  Common prefixes follow Kasai: a position's prefix is at least that of
    the position before less one; blocks of positions advance together.  Suffixes
    still tied at that depth share `width` bytes, and say nothing about the next.
    """
    n = len(seg)
    pad = np.concatenate([seg, np.zeros(width + 16, np.uint8)])
    key = np.zeros(n + width + 8, U64)
    for j in range(8):
        key <<= U64(8)
        key |= pad[j : j + n + width + 8]
    del pad
    # positions and ranks have 32 bits: a shard's text is far smaller
    sa = np.argsort(key[:n]).astype(np.int32)
    ks = key[sa]
    rank = np.zeros(n + 2 * width, np.uint32)
    new = np.concatenate([[True], ks[1:] != ks[:-1]])
    del ks
    first = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    rank[sa] = first + 1
    del first
    slots = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
    depth = 8
    while depth < width and len(slots):
        act = sa[slots]
        k2 = rank[act].astype(U64)
        k2 <<= U64(32)
        k2 |= rank[act + depth]
        order = np.argsort(k2)
        act = act[order]
        k2 = k2[order]
        del order
        sa[slots] = act
        new = np.concatenate([[True], k2[1:] != k2[:-1]])
        del k2
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots), dtype=np.int32), np.int32(0)))]
        rank[act] = start.astype(np.uint32) + np.uint32(1)
        del start, act
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
    del rank, slots
    step = 32
    rows = -(-n // step)
    plcp = np.zeros(rows * step, np.int16)
    length = np.zeros(rows, np.int64)
    base = np.arange(rows) * step
    was = np.zeros(rows, bool)
    for j in range(step):
        p = base + j
        ok = p < n
        q = np.where(ok, before[np.minimum(p, n - 1)], -1)
        length = np.where(was, 0, np.maximum(length - 1, 0))
        length[q < 0] = 0
        was = ok & tied[np.minimum(p, n - 1)]
        length[was] = width
        live = np.flatnonzero((q >= 0) & (length < width))
        while len(live):
            x = key[p[live] + length[live]] ^ key[q[live] + length[live]]
            same = x == 0
            more = np.zeros(len(live), np.int64)
            for b in range(1, 8):
                more += x < U64(1 << (64 - 8 * b))
            length[live] += np.where(same, 8, more)
            live = live[same & (length[live] < width)]
        plcp[p] = np.minimum(length, width)
    return sa, plcp[:n][sa]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Whether data[a:a+size] and data[b:b+size] are equal."""
    out, i = np.ones(len(a), bool), 0
    ends = np.cumsum(size)
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        s = size[i:j]
        base = np.cumsum(s) - s
        flat = np.arange(int(s.sum()))
        differ = data[np.repeat(a[i:j] - base, s) + flat] != data[np.repeat(b[i:j] - base, s) + flat]
        out[i:j] = np.add.reduceat(differ, base) == 0 if len(flat) else True
        i = j
    return out


def first_windows(data: np.ndarray, ws: np.ndarray, we: np.ndarray, tail: np.ndarray, joined: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Least order among the windows equal to each window.

    data[ws:we] is a window, tail where its last unit starts, joined whether the
    window before it is the one that starts a unit earlier.  Sorted fingerprints
    are searched by bisection for each window; equality is then checked on bytes.
    """
    n = len(ws)
    if not n:
        return order
    fp = K.span_hashes(data, ws, we)
    by = np.argsort(fp)
    f = fp[by]
    again = np.flatnonzero(f[1:] == f[:-1])
    if not len(again):
        return order
    owner = np.arange(n, dtype=np.int32)
    shared = f[again[np.concatenate([[True], again[1:] != again[:-1] + 1])]]
    lo, hi = np.searchsorted(f, shared, "left"), np.searchsorted(f, shared, "right")
    who = by[flat(lo, hi - lo)]
    group = np.repeat(np.arange(len(lo)), hi - lo)
    del fp, f, by, again
    who = who[np.lexsort((order[who], group))]
    del group
    owner[who] = np.repeat(who[np.cumsum(hi - lo) - (hi - lo)], hi - lo)
    del who
    other = owner != np.arange(n, dtype=np.int32)
    chained = np.zeros(n, bool)
    chained[1:] = joined[1:] & other[1:] & other[:-1] & (owner[1:] == owner[:-1] + 1) & joined[np.minimum(owner[1:], n - 1)]

    def differs(full: np.ndarray, last: np.ndarray) -> bool:
        size = we[full] - ws[full]
        ok = (size == we[owner[full]] - ws[owner[full]]) & (we[owner[full]] <= len(data))
        if not ok.all() or not same_bytes(data, ws[full], ws[owner[full]], size).all():
            return True
        size = we[last] - tail[last]
        return bool((size != we[owner[last]] - tail[owner[last]]).any()) or not same_bytes(data, tail[last], tail[owner[last]], size).all()

    if differs(np.flatnonzero(other & ~chained), np.flatnonzero(other & chained)):
        seen: dict[bytes, int] = {}  # two texts share a fingerprint: compare them as they are
        for i in np.argsort(order, kind="stable"):
            owner[i] = seen.setdefault(data[ws[i] : we[i]].tobytes(), int(i))
    return order[owner]


def context_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings given as 8-byte words, and the leading bytes that each shares with the one before it in that order."""
    order = np.lexsort(words[::-1])
    shared, live = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    live[:1] = False
    for w in words:
        x = np.zeros(len(order), U64)
        x[1:] = w[order[1:]] ^ w[order[:-1]]
        same = np.zeros(len(order), np.int64)
        for b in range(1, 8):
            same += x < U64(1 << (64 - 8 * b))
        shared += np.where(live, np.where(x == 0, 8, same), 0)
        live &= x == 0
    return order, shared


def first_around(data: np.ndarray, anchor: np.ndarray, at: np.ndarray, m: np.ndarray, u: Units, order: np.ndarray) -> np.ndarray:
    """Least order among the windows equal to each window of byte pieces; `order` by window.

    Piece p has m[p] windows around one anchor, at data[anchor[p]], the first of which
    starts at[p] bytes before it.  The suffixes that start at the anchors, and the
    reversed prefixes that end there, of all shards are each put in one sorted array
    with common prefixes.  Windows are equal if they start as far before their anchors,
    and their pieces share that many bytes before them and the rest after them: three
    numbers, whose class is found by binary search among those of all windows.
    """
    n, far = len(m), u.width - u.gram + 1
    pad = np.concatenate([np.zeros(u.width + 8, np.uint8), data, np.zeros(u.width + 16, np.uint8)])
    word = np.zeros(len(pad) - 7, U64)
    for j in range(8):
        word <<= U64(8)
        word |= pad[j : j + len(word)]
    del pad
    here = anchor + u.width + 8
    right = context_order([word[here + 8 * j] for j in range(-(-u.width // 8))])
    left = context_order([word[here - 8 * (j + 1)].byteswap() for j in range(-(-far // 8))])
    del word
    after, before = np.empty((far, n), np.int32), np.empty((far, n), np.int32)
    for o in range(far):
        after[o, right[0]] = np.cumsum(right[1] < u.width - o)
        before[o, left[0]] = np.cumsum(left[1] < o)
    piece = np.repeat(np.arange(n, dtype=np.int32), m)
    o = np.repeat(at, m) - flat(np.zeros(n, np.int64), m)
    key = (o.astype(U64) << U64(56)) | (after[o, piece].astype(U64) << U64(28)) | before[o, piece].astype(U64)
    del after, before, o, piece
    by = np.argsort(key)
    sorted_ = key[by]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    least = np.minimum.reduceat(order[by], head)
    return least[np.searchsorted(sorted_[head], key)]


def runs_of(flags: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Maximal runs of flagged consecutive windows: (document, first, windows)."""
    i = np.flatnonzero(flags)
    if not len(i):
        return i, i, i
    d, s = doc[i], start[i]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
    first = np.flatnonzero(new)
    return d[first], s[first], np.diff(np.append(first, len(i)))


def result_of(u: Units, data: np.ndarray, cover: list[tuple[np.ndarray, np.ndarray]], keep_text: bool):
    """One document's counts, hash of what is kept, and the kept text (its whole characters)."""
    one = np.array([0, len(data)])
    if u.kind == "words":
        starts, ends, _ = K.spans(data, one)
        total = len(starts)
    else:
        total = len(data)
    edge = np.zeros(total + 1, np.int64)
    for s, n in cover:
        np.add.at(edge, s, 1)
        np.add.at(edge, s + n + u.width - 1, -1)
    gone = np.cumsum(edge)[:total] > 0
    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if total else 0
    if u.kind == "bytes":
        kept = data[~gone].tobytes()
    else:
        text = data.tobytes()
        kept = b" ".join(text[i:j] for i, j in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
    return total, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), (kept.decode("utf-8", "ignore") if keep_text else None)


RESULT = "doc_id bigint, th bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string, rest string"
SHARD = f"kind int, bucket int, meta binary, payload binary, {RESULT}, pack binary"
#: text of waiting documents in one blob
WAITING_BYTES = 1 << 20
META = np.dtype([("doc", "<i8"), ("th", "<i8"), ("code", "<u8"), ("start", "<i8"), ("n", "<i4"), ("size", "<i4"), ("at", "<i4")])
FOUND = np.dtype([("doc", "<i8"), ("th", "<i8"), ("start", "<i8"), ("n", "<i4")])
COVER = np.dtype([("start", "<i8"), ("n", "<i8")])


def cover_blob(start, n) -> bytes:
    out = np.empty(len(start), COVER)
    out["start"], out["n"] = start, n
    return out.tobytes()


@dataclass(frozen=True)
class Level:
    """A level of the merge: groups of `span` shards, each dealt out over `buckets` tasks by anchor."""

    span: int
    buckets: int

    def bucket(self, shard, code: np.ndarray) -> np.ndarray:
        return (np.asarray(shard) // self.span * self.buckets + (K.mix(code) % U64(self.buckets)).astype(np.int64)).astype(np.int64)


def levels_for(shards: int, size: int) -> list[Level]:
    """Levels until all shards have met; all tasks of a level together take `size` bytes, about MERGE_BYTES each."""
    out, span = [], 1
    while not out or span < shards:
        span = min(span * FAN, shards)
        groups = -(-shards // span)
        out.append(Level(span, parts_for(size // groups, MERGE_BYTES)))
    return out


def by_bucket(meta: np.ndarray, bucket: np.ndarray, data: np.ndarray, begin: np.ndarray):
    """Rows (bucket, meta, payload) of pieces that begin in data at these places."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        own = by[x:y]
        yield int(bucket[own[0]]), packed(meta[own].tobytes()), packed(data[flat(begin[own], meta["size"][own].astype(np.int64))].tobytes())


def shard_rows(u: Units, buckets: int, level: Level, keep_text: bool):
    """Work on one shard: documents and their candidate codes in; finished rows, pieces and waiting documents out.

    The bucket of a waiting row is its shard.
    """
    names = [x.split()[0] for x in SHARD.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        cand = table.filter(pa.compute.is_null(table.column("pack"))).select(["codes", "ids"])
        docs = pa.Table.from_batches([unbundled(x) for x in table.column("pack").drop_null().to_pylist()], DOC)
        docs = docs.sort_by([("doc_id", "ascending"), ("th", "ascending")])
        ids = ids_of(docs.column("doc_id"))
        ths = docs.column("th").to_numpy()
        own = tokens_of(ids, ths)
        data, offsets = K.buffers(docs.column("text"))
        ccodes = np.frombuffer(b"".join(cand.column("codes").to_pylist()), "<u8")
        cids = np.frombuffer(b"".join(cand.column("ids").to_pylist()), "<i8")
        wanted = np.sort(K.mix(ccodes ^ K.mix(cids.view(U64))))
        n = len(ids)
        parts = []  # candidate runs by document
        spans = []
        for i, j in K.cut(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            h, uoff, words = units_of(u, part, off)
            lo, m, a, d, far = anchor_runs(u, h, uoff)
            code = code_of(a, buckets)
            k = K.mix(code ^ K.mix(own[i:j][d].view(U64)))
            at = np.searchsorted(wanted, k)
            hit = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == k)) if len(wanted) else np.zeros(0, np.int64)
            lo, m, d, code, far = lo[hit], m[hit], d[hit], code[hit], far[hit]
            if len(lo):
                if words is None:  # byte positions in the shard's data
                    b0, b1 = lo + offsets[i], lo + m - 1 + u.width + offsets[i]
                    parts.append((d + i, lo - uoff[d], m, code, b0, b1, far))
                else:
                    s, e = words
                    spans.append((d + i, lo - uoff[d], m, code, [part[s[x] : e[x + c + u.width - 2]] for x, c in zip(lo, m, strict=True)]))
        pieces, doc, start, seen, pend = local_first(u, data, parts, spans, ids)
        cover: dict[int, tuple] = {}
        rd, rs, rn = runs_of(seen, doc, start)
        cuts = np.flatnonzero(np.concatenate([[True], rd[1:] != rd[:-1], [True]])) if len(rd) else np.zeros(1, np.int64)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            cover[int(rd[x])] = (rs[x:y], rn[x:y])
        rows: dict[str, list] = {k: [] for k in names}

        def add(**x):
            for k in names:
                rows[k].append(x.get(k))

        for b, meta, payload in pieces(level, shard, ids, ths):
            add(kind=1, bucket=b, meta=meta, payload=payload)
        for i, j in K.cut(np.concatenate([[0], np.cumsum(np.diff(offsets)[pend])]), WAITING_BYTES):
            covers = [cover_blob(*cover[d]) if d in cover else b"" for d in pend[i:j].tolist()]
            held = docs.take(pa.array(pend[i:j])).set_column(DOC.get_field_index("cover"), DOC.field("cover"), pa.array(covers, pa.large_binary()))
            add(kind=2, bucket=shard, pack=bundled(held))
        waiting = set(pend.tolist())
        rests = docs.column("rest")
        for i in range(n):
            if i in waiting:
                continue
            found = cover.get(i)
            who = {"doc_id": None if ids[i] == LAST else int(ids[i]), "th": int(ths[i]), "rest": rests[i].as_py()}
            total, gone, n_spans, sha, kept = result_of(u, data[offsets[i] : offsets[i + 1]], [found] if found else [], keep_text)
            add(kind=0, n_units=total, n_removed=gone, n_spans=n_spans, kept_sha256=sha, kept_text=kept, **who)
        return pa.table({k: pa.array(rows[k], t) for k, t in zip(names, SHARD_TYPES, strict=True)})

    return run


SHARD_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]


def flat(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] numbers, then from lo[1] and so on."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def local_first(u: Units, data, parts, spans, ids):
    """Windows at candidate anchors that are not the first in the shard, and the pieces that hold the first ones."""
    z = np.zeros(0, np.int64)
    if not parts and not spans:
        return (lambda *_: ()), z, z, z.astype(bool), z
    dense = np.unique(ids, return_inverse=True)[1]  # rows with one id have one place
    if u.kind == "bytes":
        d, s, m, code, b0, b1, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        # segments: unions of the runs' bytes, laid side by side
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (b0[1:] > np.maximum.accumulate(b1)[:-1])])
        first = np.flatnonzero(new)
        s0, s1 = b0[first], np.maximum.reduceat(b1, first)
        seg = data[flat(s0, s1 - s0)]
        at = np.cumsum(s1 - s0) - (s1 - s0)
        which = np.cumsum(new) - 1
        sa, lcp = suffix_groups(seg, u.width)
        w = flat(at[which] + b0 - s0[which], m).astype(np.int32)  # windows by place in seg
        doc, start = np.repeat(d.astype(np.int32), m), flat(s, m).astype(np.int32)
        place = np.full(len(seg), -1, np.int32)
        place[w] = np.arange(len(w), dtype=np.int32)
        who, g = place[sa], np.cumsum(lcp < u.width, dtype=np.int32)
        del place, sa, lcp
        held = who >= 0
        who, g = who[held], g[held]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        del g, held
        order = (dense[doc].astype(np.int64) << 40) | start
        least = np.minimum.reduceat(order[who], head)
        best = np.empty(len(w), np.int64)
        best[who] = np.repeat(least, np.diff(np.append(head, len(who))))
        later = best < order
        del best, order, who
        text, wstart, wend = seg, w, w + np.int32(u.width)
    else:
        d, s, m, code = (np.concatenate([x[i] for x in spans]) for i in range(4))
        far = np.zeros(len(m), np.int64)
        raw = [p for x in spans for p in x[4]]
        text, ws, we, tail, joined, _ = word_windows(raw, m, u.width)
        doc, start = np.repeat(d, m), flat(s, m)
        order = (dense[doc].astype(np.int64) << 40) | start
        later = first_windows(text, ws, we, tail, joined, order) < order
        wstart, wend = ws, we
    run = np.repeat(np.arange(len(m), dtype=np.int32), m)
    first = ~later
    pend = np.unique(doc[first])

    def pieces(level: Level, shard: int, ids, ths):
        i = np.flatnonzero(first)
        new = np.concatenate([[True], (run[i][1:] != run[i][:-1]) | (start[i][1:] != start[i][:-1] + 1)])
        a = i[np.flatnonzero(new)]
        n = np.diff(np.append(np.flatnonzero(new), len(i)))
        z = a + n - 1
        meta = np.empty(len(a), META)
        meta["doc"], meta["th"], meta["code"], meta["start"], meta["n"], meta["size"] = ids[doc[a]], ths[doc[a]], code[run[a]], start[a], n, wend[z] - wstart[a]
        meta["at"] = far[run[a]] - (start[a] - s[run[a]])
        yield from by_bucket(meta, level.bucket(shard, meta["code"]), text, wstart[a])

    return pieces, doc, start, later, pend


def word_windows(raw: list, m: np.ndarray, width: int):
    """Pieces of text as words joined by one space, and the windows in them."""
    data = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    sizes = np.array([len(x) for x in raw], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    s, e, doc = K.spans(data, off)
    length = e - s + 1
    out = np.full(int(length.sum()), 32, np.uint8)
    ns = np.cumsum(length) - length
    ne = ns + length - 1
    out[flat(ns, e - s)] = data[flat(s, e - s)]
    base = np.searchsorted(doc, np.arange(len(m)))
    w = flat(base, m)
    joined = np.ones(len(w), bool)
    joined[np.cumsum(m) - m] = False
    return out, ns[w], ne[w + width - 1], ns[w + width - 1], joined, w


MERGED = "shard int, cover binary, bucket int, meta binary, payload binary"


def merge_rows(u: Units, shards: int, above: Level | None):
    """Compare the first windows of a group of shards in one bucket.

    Out come each document's windows that start earlier elsewhere, by shard, and
    the pieces of the others for the level above, if there is one.
    """

    def run(table: pa.Table) -> pa.Table:
        meta = np.frombuffer(b"".join(unpacked(x) for x in table.column("meta").to_pylist()), META)
        data = np.frombuffer(b"".join(unpacked(x) for x in table.column("payload").to_pylist()), np.uint8)
        size, m = meta["size"].astype(np.int64), meta["n"].astype(np.int64)
        off = np.cumsum(size) - size
        start, piece = flat(meta["start"], m), np.repeat(np.arange(len(m), dtype=np.int32), m)
        dense = np.unique(meta["doc"], return_inverse=True)[1]
        order = (np.repeat(dense, m).astype(np.int64) << 40) | start
        if u.kind == "bytes":
            ws = flat(off, m).astype(np.int32)
            we = ws + np.int32(u.width)
            later = first_around(data, off + meta["at"], meta["at"].astype(np.int64), m, u, order) < order
        else:
            data, ws, we, tail, joined, _ = word_windows([data[o : o + s] for o, s in zip(off, size, strict=True)], m, u.width)
            later = first_windows(data, ws, we, tail, joined, order) < order
        pd_, ps, pn = runs_of(later, piece, start)
        out = np.empty(len(pd_), FOUND)
        out["doc"], out["th"], out["start"], out["n"] = meta["doc"][pd_], meta["th"][pd_], ps, pn
        shard = shard_of(tokens_of(out["doc"], out["th"]), shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1], [True]])) if len(by) else np.zeros(1, np.int64)
        rows = [(int(shard[by[x]]), packed(out[by[x:y]].tobytes()), None, None, None) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        if above is not None:
            kd, ks, kn = runs_of(~later, piece, start)
            a = (np.cumsum(m) - m)[kd] + ks - meta["start"][kd]  # a kept run's first window
            kept = meta[kd].copy()
            kept["start"], kept["n"], kept["size"] = ks, kn, we[a + kn - 1] - ws[a]
            kept["at"] -= (ks - meta["start"][kd]).astype(np.int32)
            home = shard_of(tokens_of(kept["doc"], kept["th"]), shards)
            rows += [(None, None, *x) for x in by_bucket(kept, above.bucket(home, kept["code"]), data, ws[a])]
        types = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(("shard", "cover", "bucket", "meta", "payload"), types, strict=True))})

    return run


def finish_rows(u: Units, keep_text: bool):
    """Put together what was found of each waiting document."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        late = table.filter(pa.compute.is_null(table.column("pack")))
        hits = np.frombuffer(b"".join(unpacked(x) for x in late.column("cover").to_pylist()), FOUND)
        hits = hits[np.lexsort((hits["th"], hits["doc"]))]
        new = (hits["doc"][1:] != hits["doc"][:-1]) | (hits["th"][1:] != hits["th"][:-1])
        cuts = np.flatnonzero(np.concatenate([[True], new, [True]])) if len(hits) else np.zeros(1, np.int64)
        found = {(int(hits["doc"][x]), int(hits["th"][x])): (x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)}
        rows = []
        for raw in table.column("pack").drop_null().to_pylist():
            docs = unbundled(raw)
            data, offsets = K.buffers(docs.column("text"))
            for i, (d, t, c, rest) in enumerate(zip(*(docs.column(k).to_pylist() for k in ("doc_id", "th", "cover", "rest")), strict=True)):
                own = np.frombuffer(c, COVER)
                cover = [(own["start"], own["n"])]
                if (span := found.get((LAST if d is None else d, t))) is not None:
                    x = hits[span[0] : span[1]]
                    cover.append((x["start"], x["n"].astype(np.int64)))
                rows.append((d, t, *result_of(u, data[offsets[i] : offsets[i + 1]], cover, keep_text), rest))
        cols = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table({k: pa.array(list(c), ty) for k, c, ty in zip(names, cols, SHARD_TYPES[4:12], strict=True)})

    return run


def remove_repeats(docs: DataFrame, u: Units, candidates: DataFrame, buckets: int, shards: int, size: int, keep_text: bool) -> DataFrame:
    """Steps 2 to 4 of the module's account.  docs: doc_id, text (not null), rest (carried along); candidates: CODES; size: bytes of text."""
    none = F.lit(None).cast("binary")
    levels = levels_for(shards, size)
    left = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", "rest")
    right = candidates.select("shard", none.alias("pack"), "codes", "ids")
    out = written(left.mapInArrow(doc_rows(shards), PACK).unionByName(right).groupBy("shard").applyInArrow(K.released(shard_rows(u, buckets, levels[0], keep_text)), SHARD), "repeat-shards")
    pieces, found = out.where("kind = 1").select("bucket", "meta", "payload"), None
    for i, above in enumerate([*levels[1:], None]):
        merged = pieces.groupBy("bucket").applyInArrow(K.released(merge_rows(u, shards, above)), MERGED)
        if above is not None:
            merged = written(merged, f"repeat-level-{i}")
            pieces = merged.where("bucket is not null").select("bucket", "meta", "payload")
        late = merged.where("shard is not null").select("shard", "cover") if above is not None else merged.select("shard", "cover")
        found = late if found is None else found.unionByName(late)
    waiting = out.where("kind = 2").select(F.col("bucket").alias("shard"), "pack", none.alias("cover"))
    both = waiting.unionByName(found.select("shard", none.alias("pack"), "cover"))
    done = both.groupBy("shard").applyInArrow(K.released(finish_rows(u, keep_text)), RESULT)
    return out.where("kind = 0").select(*done.columns).unionByName(done)
