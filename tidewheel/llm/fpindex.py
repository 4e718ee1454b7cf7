"""Incremental substring deduplication with a log-structured fingerprint index."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.llm import kernels as K
from tidewheel.llm.repeats import ANCHOR_SCHEMA, CODES, KNOWN, Units, anchor_rows, carried, hashed, packed_codes, remove_repeats, shards_for, tokens_of
from tidewheel.llm.store import deleted, discard, new_path, parts_for, releasing, text_bytes, written

RUN = "bucket int, fps binary, ids binary"
DOCS = "token bigint, doc_id bigint, text string"
#: bits of the filter that picks what earlier batches have of a batch's codes (8 MB)
FILTER_BITS = 1 << 26
#: runs beside which a new one makes the index compact itself
FANOUT = 3


def sorted_run(fp: np.ndarray, ids: np.ndarray):
    """One entry for each fingerprint, sorted; KNOWN if it is already known to repeat."""
    order = np.lexsort((ids, fp))
    f, d = fp[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(f)))
    return f[first], np.where(size > 1, KNOWN, d[first])


def entries(table: pa.Table, rows: np.ndarray):
    part = table.take(pa.array(rows))
    return K.buffers(part.column("fps"))[0].view("<u4"), K.buffers(part.column("ids"))[0].view("<i8")


def merge_join(shards: int):
    """Merge the batch's fingerprints of one bucket with those of every run.

    Out come rows of two kinds: codes of documents whose windows may repeat
    (new ones, and historical ones met for the first time), and the new run.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        age = table.column("age").to_numpy()
        fp, ids = entries(table, np.flatnonzero(age < 0))
        inside = K.repeated(fp)
        hits_c, hits_d = [fp[inside & (ids != KNOWN)]], [ids[inside & (ids != KNOWN)]]
        f, d = sorted_run(fp, ids)
        old = np.zeros(len(f), bool)
        for a in np.unique(age[age >= 0]):
            hf, hd = entries(table, np.flatnonzero(age == a))
            if not len(hf):
                continue
            at = np.minimum(np.searchsorted(hf, f), len(hf) - 1)
            met = hf[at] == f
            old |= met
            them = hd[at[met]]
            hits_c.append(f[met][them != KNOWN])
            hits_d.append(them[them != KNOWN])
        own = old & (d != KNOWN)
        hits_c.append(f[own])
        hits_d.append(d[own])
        codes = (K.U64(bucket) << K.U64(32)) | np.concatenate(hits_c).astype(K.U64)
        # a fingerprint that an older run holds is now known to repeat; the run says so from here on
        new = pa.table({"bucket": pa.array([bucket], pa.int32()), "shard": pa.nulls(1, pa.int32()), "codes": pa.array([f.astype("<u4").tobytes()], pa.binary()), "ids": pa.array([np.where(old, KNOWN, d).astype("<i8").tobytes()], pa.binary())})
        hits = [pa.table({"bucket": pa.nulls(b.num_rows, pa.int32())} | dict(zip(b.schema.names, b.columns, strict=True))) for b in packed_codes(codes, np.concatenate(hits_d), shards)]
        return pa.concat_tables([new, *hits])

    return run


def compacted(table: pa.Table) -> pa.Table:
    fp, ids = entries(table, np.arange(table.num_rows))
    f, d = sorted_run(fp, ids)
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "fps": pa.array([f.astype("<u4").tobytes()], pa.binary()), "ids": pa.array([d.astype("<i8").tobytes()], pa.binary())})


def slots_of(codes: np.ndarray) -> np.ndarray:
    return (K.mix(codes) % K.U64(FILTER_BITS)).astype(np.int64)


def code_filter(candidates: DataFrame) -> np.ndarray:
    """Bits of the slots that the candidates' codes have."""

    def words(batches):
        for b in batches:
            for raw in b.column(1).to_pylist():
                slot = np.unique(slots_of(np.frombuffer(raw, "<u8")))
                word, first = np.unique(slot >> 6, return_index=True)
                bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)), first) if len(slot) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = candidates.mapInArrow(words, "word int, bits bigint").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def filtered(held):
    """Candidates whose codes may be in the filter."""

    def run(batches):
        for b in batches:
            rows = []
            for shard, codes, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c, d = np.frombuffer(codes, "<u8"), np.frombuffer(ids, "<i8")
                slot = slots_of(c)
                hit = (held.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                if hit.any():
                    rows.append((shard, c[hit].tobytes(), d[hit].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "codes", "ids"])

    return run


def token_rows(batches):
    for b in batches:
        for raw in b.column(2).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.frombuffer(raw, "<i8")))], ["token"])


class FingerprintIndex:
    """Sorted immutable runs of anchor fingerprints of all documents seen so far.

    A run is a Parquet table with one row for each bucket: fingerprints in order
    and the document that had each first (KNOWN: known to repeat).  `ingest` merge-joins a batch with the runs,
    adds a run and compacts when there are more than FANOUT.  What it returns are
    candidates; `remove_repeats` verifies them on text.  `add` does all of it for one
    batch: it keeps documents and candidates in the index too, and reads of the earlier
    documents those that share a candidate with the batch.  Entries are anchors'
    fingerprints, about an eighth of all windows; every window has one.

    After each change a manifest with a higher number names the runs that count.
    An index whose path has manifests goes on from the last one, with the buckets
    it was made with.
    """

    def __init__(self, spark: SparkSession, units: Units, buckets: int, shards: int, path: str | None = None):
        self.spark, self.units, self.buckets, self.shards = spark, units, buckets, shards
        self.path = path or new_path(spark, "fp-index")
        self.runs: list[str] = []
        self.scratch: list[DataFrame] = []  # what the candidates returned so far are read from
        self.kept: list[str] = []  # numbers of the batches whose documents and candidates are kept
        self.top: int | None = None
        self.made = self.version = 0
        if path:
            self._load()

    def _load(self) -> None:
        try:
            rows = self.spark.read.text(f"{self.path}/manifest-*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        last = max((json.loads(r["value"]) for r in rows), key=lambda m: m["version"])
        if last["units"] != asdict(self.units):
            raise ValueError(f"the index at {self.path} is of other units: {last['units']}")
        self.buckets, self.made, self.version = last["buckets"], last["made"], last["version"]
        self.runs = [f"{self.path}/{name}" for name in last["runs"]]
        self.shards, self.kept, self.top = last["shards"], last["kept"], last["top"]

    def _save(self) -> None:
        self.version += 1
        names = [run.rsplit("/", 1)[1] for run in self.runs]
        state = {"version": self.version, "made": self.made, "buckets": self.buckets, "shards": self.shards, "units": asdict(self.units), "runs": names, "kept": self.kept, "top": self.top}
        self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(state)).alias("value")).write.text(f"{self.path}/manifest-{self.version:05d}")

    def _add(self, df: DataFrame) -> str:
        path = f"{self.path}/run-{self.made:05d}"
        self.made += 1
        with releasing(self.spark):  # a run that no manifest names was left by a failed attempt
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path)

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Candidates (shard, codes, ids) that the batch (doc_id, text) brings, of its own and of earlier documents."""
        found = self._merge(batch)
        self._save()
        if len(self.runs) > FANOUT:
            self.compact()
        return found

    def add(self, batch: DataFrame, keep_text: bool = False) -> DataFrame:
        """Removals of a batch (doc_id, text) against itself and all batches added before: one row for each row of the batch.

        Columns as those of `substring_dedup`.  Ids are not null and follow those of earlier
        batches.  Earlier documents are only read where they share a candidate with the
        batch.  A batch that fails before its manifest is written leaves the index as it was.
        """
        docs = carried(batch, [])
        r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count_if(F.col("doc_id").isNull()).alias("null")).first()
        if r["null"] or (self.top is not None and r["lo"] is not None and r["lo"] <= self.top):
            raise ValueError("a batch's ids are not null and follow those of earlier batches")
        found, before = self._merge(docs), list(self.kept)
        number = f"{self.version + 1:05d}"
        token = F.pandas_udf(lambda ids, th: pd.Series(tokens_of(ids.to_numpy(), th.to_numpy())), "bigint")
        with releasing(self.spark):
            found.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/posts-{number}")
            docs.select(token(F.col("doc_id"), F.xxhash64("text")).alias("token"), "doc_id", "text").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/docs-{number}")
        discard(*self.scratch)
        self.scratch, self.kept = [], [*self.kept, number]
        self.top = r["hi"] if r["hi"] is not None else self.top
        self._save()
        if len(self.runs) > FANOUT:
            self.compact()

        posts = lambda names: reduce(DataFrame.unionByName, (self.spark.read.schema(CODES).parquet(f"{self.path}/posts-{n}") for n in names))
        own = self.spark.read.schema(DOCS).parquet(f"{self.path}/docs-{number}").withColumn("rest", F.lit(None).cast("string"))
        candidates, whole = posts([number]), own
        if before:
            bits = self.spark.sparkContext.broadcast(code_filter(candidates))  # FILTER_BITS: fixed
            candidates = candidates.unionByName(posts(before).mapInArrow(filtered(bits), CODES))
            tokens = candidates.mapInArrow(token_rows, "token bigint").distinct()
            old = reduce(DataFrame.unionByName, (self.spark.read.schema(DOCS).parquet(f"{self.path}/docs-{n}") for n in before))
            whole = own.unionByName(old.join(tokens, "token", "left_semi").withColumn("rest", F.lit(None).cast("string")))
            whole = written(whole, "fp-hits")
        _, size = text_bytes(whole)
        out = remove_repeats(whole.select("doc_id", "text", "rest"), self.units, candidates, self.buckets, self.shards, size, keep_text)
        if before:
            discard(whole)
            out = out.where(F.col("doc_id") >= r["lo"]) if r["lo"] is not None else out.limit(0)
        return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256", *(["kept_text"] if keep_text else []))

    def _merge(self, batch: DataFrame) -> DataFrame:
        met = written(hashed(batch).mapInArrow(anchor_rows(self.units, self.buckets, self.shards), ANCHOR_SCHEMA), "fp-batch")
        new = met.where("bucket is not null").select("bucket", F.col("codes").alias("fps"), "ids", F.lit(-1).alias("age"))
        sides = [new, *(self._read(p).withColumn("age", F.lit(i)) for i, p in enumerate(self.runs))]
        joined = written(reduce(DataFrame.unionByName, sides).groupBy("bucket").applyInArrow(merge_join(self.shards), ANCHOR_SCHEMA), "fp-joined")
        self.scratch += [met, joined]
        self.runs.append(self._add(joined.where("bucket is not null").select("bucket", F.col("codes").alias("fps"), "ids")))
        return met.where("bucket is null").unionByName(joined.where("bucket is null")).select("shard", "codes", "ids")

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        old = self.runs
        whole = reduce(DataFrame.unionByName, map(self._read, old))
        self.runs = [self._add(whole.groupBy("bucket").applyInArrow(compacted, RUN))]
        self._save()
        for path in old:
            deleted(self.spark, path)


def substring_dedup(docs: DataFrame, width: int = 20, batches: int = FANOUT + 2, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts earlier in the corpus.

    Documents go through a FingerprintIndex in `batches` ranges of doc_id, as they
    would come in over time; each batch is merge-joined with the runs of all
    earlier ones, the last one with a compacted run.  The windows it finds are compared
    word by word, for all batches together; `FingerprintIndex.add` does so batch by batch.

    Returns doc_id, n_words, n_removed, kept_sha256 (and kept_text and the
    columns to carry, if asked for), one row for each row of docs.  Null texts have no words; a null doc_id comes last in order and is in
    the last batch; rows with one doc_id are one document given more than once.
    Other columns are ignored.
    """
    fields = [f for f in docs.schema if f.name in (carry or [])]
    docs = carried(docs, carry or [])
    u = Units("words", width, 5, "hash")
    _, size = text_bytes(docs)
    buckets, shards = parts_for(size, 64 << 20), shards_for(size)
    r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0, 0)
    index = FingerprintIndex(docs.sparkSession, u, buckets, shards)
    found = []
    for i in range(batches):
        a, b = lo + (hi - lo + 1) * i // batches, lo + (hi - lo + 1) * (i + 1) // batches
        last = i == batches - 1
        inside = (F.col("doc_id") >= a) & (F.lit(True) if last else F.col("doc_id") < b)
        found.append(index.ingest(docs.where(inside | F.col("doc_id").isNull() if last else inside)))
    out = remove_repeats(docs, u, reduce(DataFrame.unionByName, found), buckets, shards, size, keep_text)
    discard(*index.scratch)
    deleted(docs.sparkSession, index.path)
    cols = ["doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256"]
    rest = F.from_json("rest", StructType(fields))
    return out.select(*cols, *(["kept_text"] if keep_text else []), *(rest[f.name].alias(f.name) for f in fields))
