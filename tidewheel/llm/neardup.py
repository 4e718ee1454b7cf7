"""Near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.components import components
from tidewheel.llm.store import discard, parts_for, written

#: symbols of a signature; each is a 16-bit MinHash value
SIGNATURE = 60
#: the chance to miss a pair at the threshold asked for is this at most
MISS = 1e-5
#: a key with more members than this links all of them to its smallest as candidates
HOT_KEY = 2000
#: keys that hold more than a share of 1 / MOST_HOT of all members are looked up by broadcast: fewer than MOST_HOT of them
MOST_HOT = 100_000
#: documents of a candidate cluster in one block at most
BLOCK = 4096
#: a cluster of more documents than this is split for parallel work, into SPLIT blocks of that size before blocks grow
SHARE, SPLIT = 512, 8


def distance_of(chunks: int) -> int:
    """One wrong symbol is allowed in a chunk, so any pair that differs in at most this many symbols agrees on some chunk up to one symbol (pigeonhole)."""
    return 2 * chunks - 1


def miss_rate(chunks: int, percent: int) -> float:
    """The chance that signatures of two sets with a similarity of percent/100 differ in more symbols than that."""
    p = percent / 100
    return sum(comb(SIGNATURE, i) * (1 - p) ** i * p ** (SIGNATURE - i) for i in range(distance_of(chunks) + 1, SIGNATURE + 1))


def chunks_for(percent: int) -> int:
    """The fewest chunks (of 5, 4 or 3 symbols) with which pairs at the threshold are missed with a chance of MISS at most."""
    for chunks in (12, 15, 20):
        if miss_rate(chunks, percent) <= MISS:
            return chunks
    raise ValueError(f"a similarity of {percent} percent is too low for {SIGNATURE} symbols: more than {MISS} of the pairs would be missed")


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int):
    """Distinct k-word shingle hashes of each lower-cased text: (hashes sorted by document, document indexes)."""
    n = len(offsets) - 1
    data = K.lower_table()[data]
    starts, ends, doc = K.spans(data, offsets)
    words = K.span_hashes(data, starts, ends)
    h = K.shingles(words, k)
    inside = np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    h, d = h[inside], doc[inside]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):  # the whole sequence is the one shingle
        first = np.searchsorted(doc, short)
        own = np.zeros(len(short), K.U64)
        for j in range(k - 1):
            there = count[short] > j
            own[there] = K.mix(own[there] * K.U64(31) + words[first[there] + j] + K.U64(j + 1))
        h, d = np.concatenate([h, own]), np.concatenate([d, short])
    # 54 bits of the hash below the document's index sort with no index array
    packed = np.sort((d.astype(K.U64) << K.U64(54)) | (h >> K.U64(10)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    return packed & K.U64((1 << 54) - 1), (packed >> K.U64(54)).astype(np.int64)


def signatures(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """n rows of 16-bit MinHash symbols; rows without shingles are zero."""
    out = np.zeros((n, SIGNATURE), np.uint16)
    if len(h):
        h = K.mix(h)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        seeds = K.mix(np.arange(1, 2 * SIGNATURE + 1, dtype=K.U64))
        for i in range(SIGNATURE):
            v = np.minimum.reduceat((h ^ seeds[2 * i]) * (seeds[2 * i + 1] | K.U64(1)), first)
            out[d[first], i] = (K.mix(v) >> K.U64(48)).astype(np.uint16)
    return out


def feature_batches(k: int):
    def run(batches):
        for rows, data, offsets in K.blocks(batches):
            n = len(offsets) - 1
            h, d = sets_of(data, offsets, k)
            size = np.bincount(d, minlength=n).astype(np.int64)
            m = K.mix(h)
            cum = np.zeros(len(h) + 1, K.U64)
            ends = np.cumsum(size)
            digests = []
            for salt in (K.U64(0x51), K.U64(0xA7)):
                np.cumsum(K.mix(m + salt), out=cum[1:])
                digests.append((cum[ends] - cum[ends - size]).view(np.int64))
            sig = signatures(h, d, n).astype("<u2").tobytes()
            width = 2 * SIGNATURE
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).cast(pa.int64()),
                    pa.array(size),
                    pa.array(digests[0]),
                    pa.array(digests[1]),
                    pa.array([sig[i * width : (i + 1) * width] for i in range(n)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "dig_a", "dig_b", "sig"],
            )

    return run


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """Keys of all chunks with each one of their symbols left out: n x SIGNATURE."""
    out = np.empty((len(sig), SIGNATURE), K.U64)
    symbols = SIGNATURE // chunks
    for c in range(chunks):
        part = sig[:, c * symbols : (c + 1) * symbols].astype(K.U64)
        for w in range(symbols):
            key = np.zeros(len(sig), K.U64)
            for s in range(symbols):
                if s != w:
                    key = (key << K.U64(16)) | part[:, s]
            out[:, c * symbols + w] = K.mix(key + K.U64((c * symbols + w + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return out


def matrix(column) -> np.ndarray:
    data, _ = K.buffers(column)
    return data.view("<u2").reshape(-1, SIGNATURE)


def key_batches(chunks: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                keys = chunk_keys(matrix(part.column(1)), chunks)
                reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SIGNATURE)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], ["key", "rep"])

    return run


def close_edges(sig: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges whose components join all members within that distance of one another."""
    n = len(sig)
    if n == 2:
        return [(0, 1)] if (sig[0] != sig[1]).sum() <= distance else []
    label, edges = np.full(n, -1), []
    for i in range(n):
        if label[i] >= 0:
            continue
        near = (sig != sig[i]).sum(1) <= distance
        label[i] = i
        for old in np.unique(label[near]):
            if old not in (-1, i):
                edges.append((i, int(old)))
                label[label == old] = i
        new = np.flatnonzero(near & (label == -1))
        edges += [(i, int(j)) for j in new]
        label[new] = i
    groups = [np.flatnonzero(label == g) for g in np.unique(label)]
    for x in range(len(groups)):  # members that no centre has seen together
        for y in range(x):
            a, b = groups[x], groups[y]
            for i in a:
                if ((sig[b] != sig[i]).sum(1) <= distance).any():
                    edges.append((int(a[0]), int(b[0])))
                    break
    return edges


def cold_keys(distance: int):
    """Candidate edges in the keys of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        rep = table.column("rep").to_numpy()
        sig = matrix(table.column("sig"))
        order = np.lexsort((rep, key))
        cuts = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]], [True]]))
        pairs = [np.zeros((0, 2), np.int64)]
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        if len(two):
            i, j = order[two], order[two + 1]
            near = np.concatenate([(sig[i[s : s + 65536]] != sig[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)]) <= distance
            pairs.append(np.stack([rep[i[near]], rep[j[near]]], 1))
        for g in np.flatnonzero(sizes > 2):
            own = order[cuts[g] : cuts[g + 1]]
            if e := close_edges(sig[own], distance):
                pairs.append(rep[own][np.array(e)])
        out = np.unique(np.sort(np.concatenate(pairs), 1), axis=0)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def exact_links(k: int, percent: int):
    """Links inside the candidate clusters (or pairs of blocks of one) of a group, confirmed on full sets.

    Intersections come from an inverted index of the cluster.  First each document
    that no link has reached yet is compared with all others; then so is each one
    outside the largest group found that way.  Pairs inside that group need no
    comparison, as they are linked already: a dense cluster of n takes about n
    comparisons, and the links returned span what all links of the cluster span.
    """

    def cluster_links(h, d, n, sides):
        size = np.bincount(d, minlength=n)
        begin = np.concatenate([[0], np.cumsum(size)])
        uniq, ids = np.unique(h, return_inverse=True)
        posting = d[np.argsort(ids, kind="stable")]
        at = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(uniq)))])
        label, reached, done, edges = np.arange(n), np.zeros(n, bool), np.zeros(n, bool), []

        def compare(x: int) -> None:
            done[x] = reached[x] = True
            mine = ids[begin[x] : begin[x + 1]]
            m = at[mine + 1] - at[mine]
            if not m.sum():
                return
            both = np.bincount(posting[np.repeat(at[mine] - (np.cumsum(m) - m), m) + np.arange(m.sum())], minlength=n)
            linked = (100 * both >= percent * (size[x] + size - both)) & (both > 0)
            linked[x] = False
            if sides is not None:  # pairs in one block are met where that block meets itself
                linked &= (sides != sides[x]) | (sides[x] == 2)
            y = np.flatnonzero(linked)
            reached[y] = True
            groups, first = np.unique(label[y], return_index=True)
            for g, i in zip(groups.tolist(), first.tolist(), strict=True):
                if g != label[x]:
                    edges.append((x, int(y[i])))
                    label[label == g] = label[x]

        for x in range(n):
            if not reached[x]:
                compare(x)
        names, sizes = np.unique(label, return_counts=True)
        for x in np.flatnonzero((label != names[sizes.argmax()]) & ~done) if len(names) > 1 else ():
            compare(int(x))
        return edges

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("slot", "ascending"), ("rep", "ascending")])
        a, b = [], []
        cluster, slot = table.column("cluster").to_numpy(), table.column("slot").to_numpy()
        rep, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        texts = table.column("text")
        cuts = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (slot[1:] != slot[:-1]), [True]]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            data, offsets = K.buffers(texts.slice(lo, hi - lo))
            hs, ds = [], []
            for i, j in K.cut(offsets):
                h, d = sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                hs.append(h)
                ds.append(d + i)
            own = rep[lo:hi]
            for x, y in cluster_links(np.concatenate(hs), np.concatenate(ds), hi - lo, side[lo:hi] if slot[lo] >= 0 else None):
                a.append(own[x])
                b.append(own[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of at least percent/100.

    Method: 60 MinHash symbols of 16 bits, split into 12, 15 or 20 chunks.  Two
    signatures that differ in at most 2 * chunks - 1 symbols agree in some chunk up
    to one symbol, so each chunk is indexed with each one symbol left out, which
    finds every pair within that distance.  The threshold decides on the chunks, so
    that a pair at it is beyond the distance with a chance of MISS at most; a
    threshold too low for that raises.  Candidates are confirmed on the full sets.

    A key with more than HOT_KEY members does not compare signatures: all of them
    become candidates of its smallest one, and the confirmation decides.

    Returns doc_id, n_shingles, component_id (smallest id reachable over links)
    and kept (doc_id = component_id), one row for each row of docs.  Null and
    wordless texts have an empty set and stand alone; equal sets are one class from
    the start, so copies cost no pairs; repeated ids are one node.  Rows with a null
    id are documents of their own that come after all others: they link and are
    linked, their component_id is null if no document with an id is in reach, and
    one of such a component is kept.  Other columns of the input are not looked at.
    An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = chunks_for(percent)
    r = docs.agg(F.max("doc_id").alias("top"), (F.count(F.lit(1)) - F.count("doc_id")).alias("nulls")).first()
    beyond = None
    if r["nulls"]:  # numbers above all ids stand for those that are missing; they are written before they are used
        beyond = 0 if r["top"] is None else r["top"] + 1
        if beyond >= 1 << 62:
            raise ValueError("ids leave no room for numbers of the rows without one")
        docs = written(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(beyond) + F.monotonically_increasing_id())), "nd-numbered")
    feats = written(docs.mapInArrow(feature_batches(shingle), "doc_id bigint, n_shingles bigint, dig_a bigint, dig_b bigint, sig binary"), "nd-features")
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("dig_a", "dig_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = written(classes, "nd-classes")
    reps = classes.select("rep", "sig")
    keys = reps.mapInArrow(key_batches(chunks), "key bigint, rep bigint")
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("least")).where("n > 1"), "nd-shared")
    r = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    n_members, limit = r["n"], max(HOT_KEY, r["n"] // MOST_HOT)
    star = lambda df: df.where("rep > least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    if r["most"] <= limit:
        members = written(keys.join(shared.hint("merge"), "key"), "nd-members")
        hot = star(members.where(f"n > {HOT_KEY}"))
    else:  # the members of the hottest keys stay where they are
        top = F.broadcast(shared.where(F.col("n") > limit).select("key", "least"))
        members = written(keys.join(top.select("key"), "key", "left_anti").join(shared.where(F.col("n") <= limit).hint("merge"), "key"), "nd-members")
        hot = star(members.where(f"n > {HOT_KEY}")).unionByName(star(keys.join(top, "key")))
    cold = members.where(f"n <= {HOT_KEY}").select("key", "rep").join(reps.hint("merge"), "rep")
    parts = parts_for(n_members * 140, 8 << 20)
    edges = cold.withColumn("bucket", F.pmod("key", F.lit(parts * 4))).groupBy("bucket").applyInArrow(K.released(cold_keys(distance_of(chunks))), "a bigint, b bigint")
    clusters = written(components(edges.unionByName(hot), "nd-candidates"), "nd-clusters")
    discard(members, shared)
    # exact confirmation: each member's text goes to its cluster, large clusters in pairs of blocks
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    # a member's text travels once for each block of its cluster: at most SPLIT times up to SPLIT * BLOCK members
    wanted = F.greatest(F.least(F.ceil(F.col("members") / SHARE), F.lit(SPLIT)), F.ceil(F.col("members") / BLOCK))
    placed = clusters.join(sizes, "component").withColumn("blocks", wanted.cast("int"))
    placed = placed.withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int"))
    one = F.array(F.struct(F.lit(-1).alias("slot"), F.lit(-1).alias("side")))
    i, n = F.col("block"), F.col("blocks")
    pairs = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.struct(
            (F.least(i, j) * n + F.greatest(i, j)).cast("int").alias("slot"),
            F.when(i == j, 2).when(i < j, 0).otherwise(1).cast("int").alias("side"),
        ),
    )
    placed = placed.select(F.col("node").alias("rep"), F.col("component").alias("cluster"), F.explode(F.when(n > 1, pairs).otherwise(one)).alias("p"))
    placed = placed.select("rep", "cluster", "p.slot", "p.side")
    texts = docs.join(placed.hint("merge"), docs["doc_id"] == placed["rep"]).drop("doc_id")
    parts = parts_for(clusters.count() * 4000, 8 << 20)
    group = F.when(F.col("slot") < 0, F.pmod(F.xxhash64("cluster"), F.lit(parts * 4))).otherwise(F.xxhash64("cluster", "slot"))
    links = texts.withColumn("task", group).groupBy("task").applyInArrow(K.released(exact_links(shingle, percent)), "a bigint, b bigint")
    found = written(components(links, "nd-links"), "nd-found")
    discard(clusters, *([] if beyond is None else [docs]))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("dig_a", "dig_b", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = feats.select("doc_id", "n_shingles", "dig_a", "dig_b").join(named, ["dig_a", "dig_b", "n_shingles"], "left")
    # an id that comes with several texts is one node
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if beyond is None:
        return out
    return out.withColumns({c: F.when(F.col(c) < beyond, F.col(c)) for c in ("doc_id", "component_id")})
