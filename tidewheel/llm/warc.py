"""Deterministic sharded WARC writing, and reading back."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.sample import threshold
from tidewheel.llm.store import discard, new_path, parts_for, releasing, written

#: fixed values: the format's names
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

#: compressed bytes after which a file is closed
ROLL = 16 << 20
SHARD_BYTES = 32 << 20
#: shards at most (they grow instead): cut points in the driver and on every executor have this bound
MOST_SHARDS = 50_000
#: ids sampled for cut points, by shard
SAMPLED = 16
#: bytes of a record beside its payload, about
HEAD_BYTES = 512
#: payloads with more rows than this, and than a share of 1 / MOST_HOT of all rows, are looked up by broadcast: MOST_HOT at most
HOT_ROWS, MOST_HOT = 4096, 100_000
DATE = "2024-01-01T00:00:00Z"
LAST = 2**63 - 1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def clean(url: str | None) -> str:
    """A header value: no line breaks, no control characters."""
    return "".join(c if c.isprintable() else f"%{ord(c) & 0xFF:02X}" for c in url or "")


def record(page_id, url, payload: bytes, digest: str, owner) -> bytes:
    """One record; a revisit of page `owner` (a page id, LAST for null) if given."""
    http = (HTTP % len(payload)).encode()
    block = http if owner is not None else http + payload
    head = [
        ("WARC-Type", "response" if owner is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest) if owner is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'revisit:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if owner is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(None if owner == LAST else owner, digest)), ("X-Refers-To-Page", "" if owner == LAST else str(owner))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def filesystem(uri: str):
    """A pyarrow file system and the path in it; any store that pyarrow knows by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Roller:
    """Write records to temporary files of one shard, closing a file once it is large enough."""

    def __init__(self, uri: str, shard: int, level: int, roll: int):
        self.fs, self.root = filesystem(uri)
        self.shard, self.level, self.roll = shard, level, roll
        self.tag = uuid.uuid4().hex  # a second attempt at the task writes other temporary files
        self.seq, self.file, self.done = 0, None, []

    def add(self, raw: bytes) -> None:
        if self.file is None:
            self.name = f"{self.root}/_temporary/{self.shard:06d}-{self.seq:05d}-{self.tag}"
            self.file, self.size, self.count, self.hash = self.fs.open_output_stream(self.name, compression=None), 0, 0, hashlib.sha256()
        c = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member without time or name
        out = c.compress(raw) + c.flush()
        self.file.write(out)
        self.hash.update(out)
        self.size += len(out)
        self.count += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.shard, self.seq, self.name, self.count, self.size, self.hash.hexdigest()))
            self.file, self.seq = None, self.seq + 1


MANIFEST = "shard int, seq int, temporary string, records bigint, bytes bigint, sha256 string"
NAMED = "name string, records bigint, bytes bigint, sha256 string"


class Shards:
    """Cut points of ids: where ranges start, and the number of shards that each is dealt out over.

    A range is one shard, but for an id that alone is larger than one: it is a range
    of its own, dealt out by payload.  Null ids come last, in a range of their own.
    """

    def __init__(self, weights: list[tuple[int | None, float]], target: float):
        null = sum(w for i, w in weights if i is None)
        starts, parts, held = [-(2**63)], [1], 0.0
        for i, w in sorted((i, w) for i, w in weights if i is not None):
            many = int(-(-w // target))
            if many > 1 or held + w > target:
                if held or many > 1 and i > starts[-1]:
                    starts.append(i)
                    parts.append(1)
                held = 0.0
                if many > 1:
                    parts[-1] = many
                    if i < LAST:
                        starts.append(i + 1)
                        parts.append(1)
                    continue
            held += w
        self.starts, self.parts = np.array(starts), np.array([*parts, max(1, int(-(-null // target)))])
        self.first = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def of(self, page_id: Column, digest: Column) -> Column:
        """The shard of a page, from its id and its payload's digest."""
        starts, parts, first = self.starts, self.parts, self.first

        @F.pandas_udf("int")
        def shard(ids, null, salt):
            at = np.where(null, len(starts), np.searchsorted(starts, ids, "right") - 1)
            import pandas as pd

            return pd.Series((first[at] + salt % parts[at]).astype(np.int32))

        return shard(F.coalesce(page_id, F.lit(0)).cast("bigint"), page_id.isNull(), F.pmod(F.xxhash64(digest), F.lit(1 << 30)))


def shards_of(pages: DataFrame) -> Shards:
    """Cut points weighted by bytes, the same for the same pages: from a sample by the ids' hashes, and all ids larger than a shard."""
    pages = pages.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + HEAD_BYTES).alias("w"))
    r = pages.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.approx_count_distinct("page_id").alias("ids")).first()
    shards = min(parts_for(r["w"], SHARD_BYTES), MOST_SHARDS)
    if shards == 1:
        return Shards([], 1.0)
    target = r["w"] / shards
    limit = threshold(r["ids"], max(SAMPLED * shards, 2000))
    seen = pages.groupBy("page_id").agg(F.sum("w").alias("w")).withColumn("sampled", F.xxhash64("page_id") <= limit)
    found = [tuple(x) for x in seen.where((F.col("w") > target) | F.col("sampled") | F.col("page_id").isNull()).collect()]
    large = [(i, w) for i, w, _ in found if w > target or i is None]
    few = [(i, w) for i, w, sampled in found if sampled and w <= target and i is not None]
    scale = (r["w"] - sum(w for _, w in large)) / max(1, sum(w for _, w in few))
    return Shards(large + [(i, w * scale) for i, w in few], target)


def owners_of(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """page_id, digest, owner: pages whose payload others have too, and the smallest id that has it (LAST for null); the table behind it.

    A payload of very many pages is looked up by broadcast, so that its pages stay where they are.
    """
    long_enough = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).select("page_id", "digest")
    # partial aggregation leaves a row for each task of a popular payload
    owners = long_enough.groupBy("digest").agg(F.coalesce(F.min("page_id"), F.lit(LAST)).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = written(owners, "warc-owners")
    r = owners.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    judged = long_enough.distinct()
    hot = max(HOT_ROWS, r["n"] // MOST_HOT)
    if r["most"] <= hot:
        return judged.join(owners.drop("n"), "digest"), owners
    few = F.broadcast(owners.where(F.col("n") > hot).drop("n"))  # fewer than MOST_HOT rows
    rest = judged.join(few.select("digest"), "digest", "left_anti").join(owners.where(F.col("n") <= hot).drop("n"), "digest")
    return judged.join(few, "digest").unionByName(rest), owners


def write_warc(pages: DataFrame, uri: str, least_bytes: int = 0, level: int = 6, roll: int = ROLL) -> DataFrame:
    """Write one record for each row of pages (page_id, url, html) under `uri`; return the manifest: name, records, bytes, sha256.

    Records are sorted by page_id and cut into shards of about equal bytes, at
    points that follow from the pages alone, so the same pages always give the same
    files.  An id whose rows exceed a shard is dealt out by payload (rows that share
    id and payload stay together).  Of records with equal payloads of at least
    `least_bytes` bytes, the one with the smallest page_id is a response and the
    others revisit it; of rows that share that id too, one is the response.  Null
    ids come last, null html is an empty payload, control characters in an url are
    escaped; other columns are ignored.

    Tasks write files under temporary names that no other attempt has, and list them
    in a table that holds the files of successful attempts only.  Further tasks give
    those their final names, a file that has it already is left.  Last comes
    manifest.json, without which an archive is not complete; what incomplete
    attempts left is deleted.  An archive that is complete is not written again:
    FileExistsError.  An empty table gives a manifest without files.
    """
    from pyarrow import fs as FS

    spark = pages.sparkSession
    fs, root = filesystem(uri)
    if fs.get_file_info(f"{root}/manifest.json").type != FS.FileType.NotFound:
        raise FileExistsError(f"{uri} holds a complete archive")
    for old in fs.get_file_info(FS.FileSelector(root, allow_not_found=True)):
        if old.base_name in ("_temporary", "_files", "_manifest"):
            fs.delete_dir(old.path)
        elif old.base_name.startswith("part-"):
            fs.delete_file(old.path)
    fs.create_dir(f"{root}/_temporary", recursive=True)

    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"), F.col("url").cast("string").alias("url"))
    shards = shards_of(pages)
    pages = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    shard = shards.of(F.col("page_id"), F.col("digest")).alias("shard")
    owned, owners = owners_of(pages, least_bytes)
    verdicts = owned.select(shard, "page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("body"), "owner")
    rows = verdicts.unionByName(pages.select(shard, "page_id", F.lit(1).alias("kind"), "url", F.col("html").alias("body"), F.lit(None).cast("bigint").alias("owner")))
    dealt = rows.repartitionById(shards.count, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "url", "body")

    def write(batches):
        out, verdict, at, answered, manifest = None, {}, object(), set(), []
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for s, page, kind, url, body, owner in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or out.shard != s:
                        if out is not None:
                            out.close()
                            manifest += out.done
                        out, at = Roller(uri, s, level, roll), object()
                    if page != at:
                        verdict, answered, at = {}, set(), page
                    if kind == 0:
                        verdict[bytes.fromhex(body)] = owner
                        continue
                    payload = (body or "").encode()
                    sha = hashlib.sha1(payload).digest()
                    target = verdict.get(sha)
                    if target == (LAST if page is None else page) and sha not in answered:
                        answered.add(sha)  # the first row of the smallest id
                        target = None
                    out.add(record(page, url, payload, base64.b32encode(sha).decode(), target))
        if out is not None:
            out.close()
            manifest += out.done
        cols = list(zip(*manifest, strict=True)) or [[]] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["shard", "seq", "temporary", "records", "bytes", "sha256"])

    def rename(batches):
        own, base = filesystem(uri)
        for b in batches:
            names = [f"part-{s:06d}-{q:05d}.warc.gz" for s, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            for temporary, name in zip(b.column(2).to_pylist(), names, strict=True):
                # a lost attempt may have renamed it
                if own.get_file_info(temporary).type != FS.FileType.NotFound or own.get_file_info(f"{base}/{name}").type == FS.FileType.NotFound:
                    own.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *b.columns[3:]], ["name", "records", "bytes", "sha256"])

    at = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    with releasing(spark):
        dealt.mapInArrow(write, MANIFEST).write.parquet(f"{at}/_files")
        discard(owners)
        files = spark.read.schema(MANIFEST).parquet(f"{at}/_files")
        files.repartition(parts_for(files.count(), 256)).mapInArrow(rename, NAMED).write.parquet(f"{at}/_manifest")
    manifest = spark.read.schema(NAMED).parquet(f"{at}/_manifest")
    r = manifest.agg(F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "bytes"))).first()
    fs.delete_dir(f"{root}/_temporary")
    fs.delete_dir(f"{root}/_files")
    with fs.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps(r.asDict() | {"table": "_manifest"}, indent=1).encode())
    fs.move(f"{root}/_manifest.json", f"{root}/manifest.json")
    return manifest


def records(stream):
    """Yield (headers, block) of each record of an uncompressed stream."""
    read = io.BufferedReader(stream, 1 << 16)
    while True:
        line = read.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if line.strip() != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := read.readline().strip()) != b"":
            k, _, v = line.decode().partition(": ")
            head[k.rstrip(":")] = v
        yield head, read.read(int(head["Content-Length"]))


class Members(io.RawIOBase):
    """The uncompressed bytes of a file of gzip members."""

    def __init__(self, file):
        self.file, self.raw, self.left = file, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, out):
        while True:
            if self.raw.eof:
                self.left = self.raw.unused_data or self.left
                self.raw = zlib.decompressobj(31)
            data = self.left or self.file.read(1 << 16)
            self.left = b""
            if not data:
                return 0
            got = self.raw.decompress(data, len(out))
            self.left = self.raw.unconsumed_tail
            if self.raw.eof:
                self.left = self.raw.unused_data
                self.raw = zlib.decompressobj(31)
            if got:
                out[: len(got)] = got
                return len(got)


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"


def read_warc(spark: SparkSession, uri: str, with_html: bool = True) -> DataFrame:
    """Records of all files in the archive's manifest; digests and lengths are checked against what is read.

    html is null for revisits.  An archive without manifest.json is not complete and raises.
    """
    fs, root = filesystem(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        head = json.loads(f.read())
    at = uri if "://" in uri or uri.startswith("file:") else f"file://{uri}"
    names = spark.read.schema(NAMED).parquet(f"{at}/{head['table']}").select("name")

    def read(batches):
        own, base = filesystem(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with own.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in records(Members(f)):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Length"])
                        if head["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        whole = head["WARC-Type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if whole else b""
                        if whole and (digest32(payload) != digest or len(payload) != size):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        number = lambda k: int(head[k]) if head.get(k) else None
                        rows.append((number("X-Page-Id"), head["WARC-Target-URI"], size, digest, head["WARC-Type"], number("X-Refers-To-Page"), payload.decode() if whole and with_html else None))
                        if len(rows) >= 512:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in READ.split(", ")])

    return names.repartition(max(1, min(head["files"], MOST_SHARDS))).mapInArrow(read, READ)


def round_trip(pages: DataFrame, least_bytes: int = 0, uri: str | None = None) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back."""
    uri = uri or new_path(pages.sparkSession, "warc")
    write_warc(pages, uri, least_bytes)
    return read_warc(pages.sparkSession, uri, with_html=False).drop("html", "url")
