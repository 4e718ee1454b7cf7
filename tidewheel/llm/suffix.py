"""Exact byte-level deduplication by suffix arrays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.llm import kernels as K
from tidewheel.llm.repeats import ANCHOR_SCHEMA, CODES, KNOWN, NO_CODES, Units, anchor_rows, carried, hashed, packed_codes, remove_repeats, shards_for
from tidewheel.llm.store import discard, parts_for, text_bytes, written

#: text of a shard: sorting its suffixes takes some fifty times as much memory
SHARD_BYTES = 4 << 20


def repeated_codes(shards: int):
    """Documents and codes of the anchors that more than one map task (or flush) has met."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        fp = K.buffers(table.column("codes"))[0].view("<u4")
        ids = K.buffers(table.column("ids"))[0].view("<i8")
        hit = K.repeated(fp) & (ids != KNOWN)
        out = list(packed_codes((K.U64(bucket) << K.U64(32)) | fp[hit].astype(K.U64), ids[hit], shards))
        return pa.Table.from_batches(out) if out else pa.table(NO_CODES)

    return run


def suffix_dedup(docs: DataFrame, width: int = 100, keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Remove every byte covered by a `width`-byte string that also starts earlier in the corpus.

    Each shard sorts the suffixes of the stretches that may repeat
    (Larsson-Sadakane), takes common prefixes (Kasai) and sends the first copy of
    every string on.  Shards are merged, group by group, by binary search among the
    ranks that the strings have in sorted arrays of the suffixes and the reversed
    prefixes around their anchors.  A stretch may repeat if its anchor (least 32-gram hash)
    occurs elsewhere, so strings that occur once are neither sorted nor sent.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text
    and the columns to carry, if asked for), one row for each row of docs.  Null texts count as empty; a null doc_id comes
    last in order; rows with one doc_id are one document given more than once
    (none is earlier than the other at equal starts).  Other columns are ignored.
    """
    fields = [f for f in docs.schema if f.name in (carry or [])]
    docs = carried(docs, carry or [])
    u = Units("bytes", width, 32, "suffix")
    _, size = text_bytes(docs)
    buckets, shards = parts_for(size, 64 << 20), shards_for(size, SHARD_BYTES)
    met = written(hashed(docs).mapInArrow(anchor_rows(u, buckets, shards), ANCHOR_SCHEMA), "suffix-anchors")
    known = met.where("bucket is null").select("shard", "codes", "ids")
    found = met.where("bucket is not null").select("bucket", "codes", "ids").groupBy("bucket").applyInArrow(repeated_codes(shards), CODES)
    out = remove_repeats(docs, u, known.unionByName(found), buckets, shards, size, keep_text)
    discard(met)
    cols = ["doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"]
    rest = F.from_json("rest", StructType(fields))
    return out.select(*cols, *(["kept_text"] if keep_text else []), *(rest[f.name].alias(f.name) for f in fields))
