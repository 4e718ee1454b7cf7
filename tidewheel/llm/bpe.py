"""Byte-level BPE encoding and decoding, with tree concatenation of long texts."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.store import discard, tasks_for, written

#: fixed value: the word-splitting pattern of the 50k byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters in a piece that is encoded on its own
PIECE = 1 << 15
#: bytes that an edge must lie from the join and from the window's ends
MARGIN = 32
#: characters of one class on each side of an edge inside a run
INSIDE = 4
#: neighbours that one task joins at a level
FAN = 8


#: classes of the first characters met
KINDS: dict[str, int] = {}


def kind_of(c: str) -> int:
    """Class of a character in PATTERN: 1 letter, 2 number, 3 other, 4 white space; 0 if versions of Unicode may not agree on it."""
    if c in KINDS:
        return KINDS[c]
    now, once = unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)
    if now == "C" and c not in "\t\n\v\f\r" or once not in ("Cn", unicodedata.category(c)):
        k = 0
    else:
        k = 4 if c.isspace() else {"L": 1, "N": 2}.get(now, 3)
    if len(KINDS) < 1 << 16:
        KINDS[c] = k
    return k


def safe_edges(window: str) -> tuple[np.ndarray, np.ndarray]:
    """By byte offset of a window: where a word ends whatever else the text has, and what lies inside a run of one class.

    Before a character of another class a run of letters, numbers or other marks
    ends with every alternative of the pattern, and neither side's words depend on
    the other's (not after an apostrophe: it may begin a contraction).  A place with
    INSIDE characters of one class on both sides is in the middle of a word.
    """
    kind = np.fromiter(map(kind_of, window), np.int8, len(window))
    size = np.fromiter((1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in window), np.int64, len(window))
    at = np.concatenate([[0], np.cumsum(size)])
    ends, inside = np.zeros(int(at[-1]) + 1, bool), np.zeros(int(at[-1]) + 1, bool)
    if len(window) > 1:
        a, b = kind[:-1], kind[1:]
        quote = np.fromiter((c == "'" for c in window[:-1]), bool, len(window) - 1)
        ends[at[1:-1]] = (a > 0) & (b > 0) & (a != b) & (a != 4) & ~(quote & (b == 1))
        run = np.concatenate([[0], np.cumsum((a == b) & (a > 0))])  # equal neighbours so far
        i = np.arange(INSIDE, len(window) - INSIDE + 1)
        if len(i):
            inside[at[i]] = run[i + INSIDE - 1] - run[i - INSIDE] == 2 * INSIDE - 1
    return ends, inside


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers format (byte-level BPE without prefix space)."""

    def __init__(self, path: str, payload: str | None = None):
        import tiktoken

        if payload is None:
            with open(path, encoding="utf-8") as f:
                payload = f.read()
        spec = json.loads(payload)
        stand = byte_of_char()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ranks = {bytes(stand[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        merged = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merged]
        if ids != sorted(ids):
            raise ValueError("merges must be in the order of their ids")
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.allowed = set(special)

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=self.allowed)

    def bytes_of(self, ids) -> bytes:
        return self.core.decode_bytes(np.asarray(ids).tolist())

    def decode(self, ids) -> str:
        return self.bytes_of(ids).decode("utf-8", errors="replace")

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token."""
        if not hasattr(self, "_sizes"):
            n = 1 + max([*self.ranks.values(), *self.special.values()])
            self._sizes = np.zeros(n, np.int64)
            for b, i in self.ranks.items():
                self._sizes[i] = len(b)
            for s, i in self.special.items():
                self._sizes[i] = len(s.encode())
        return self._sizes[ids]

    def join(self, left: np.ndarray, right: np.ndarray, reach: int = 64) -> np.ndarray:
        """Ids of the text whose halves have ids `left` and `right`.

        The tokens around the join are decoded and encoded again, over a window
        that grows until it agrees with both halves at an edge on each side of the
        join; beyond such edges nothing can differ (see `_shared`).  `encoded` holds
        the characters that the last join has encoded again.
        """
        self.encoded = 0
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            a, b = self._tokens(left[::-1], reach), self._tokens(right, reach)
            head, tail = left[len(left) - a :], right[:b]
            raw = self.bytes_of(head) + self.bytes_of(tail)
            start = 0 if a == len(left) else next((i for i in range(4) if raw[i] & 0xC0 != 0x80), 0)
            stop = len(raw)
            if b < len(right):  # end at a whole character
                stop -= next((i for i in range(5) if self._whole(raw[: len(raw) - i])), 0)
            window = raw[start:stop].decode("utf-8")
            self.encoded += len(window)
            mid = self.encode(window)
            at_mid = np.concatenate([[0], np.cumsum(self.sizes(mid))]) + start
            at_head = np.concatenate([[0], np.cumsum(self.sizes(head))])
            at_tail = at_head[-1] + np.concatenate([[0], np.cumsum(self.sizes(tail))])
            ends, inside = (np.concatenate([np.zeros(start, bool), x]) for x in safe_edges(window))
            x, y = (0, 0), (b, len(mid))
            if a < len(left):
                x = self._shared(head, at_head, mid, at_mid, MARGIN, at_head[-1] - MARGIN, ends | inside, -1)
            if b < len(right):
                y = self._shared(tail, at_tail, mid, at_mid, at_head[-1] + MARGIN, at_tail[-1] - MARGIN, ends | inside, 0)
            if x and y and x[1] <= y[1]:
                return np.concatenate([left[: len(left) - a + x[0]], mid[x[1] : y[1]], right[y[0] :]])
            reach *= 4

    def _tokens(self, ids: np.ndarray, reach: int) -> int:
        """Tokens that make up `reach` bytes."""
        size = np.cumsum(self.sizes(ids[: reach + 1]))
        return min(len(ids), int(np.searchsorted(size, reach)) + 1)

    @staticmethod
    def _whole(raw: bytes) -> bool:
        for i in range(1, min(4, len(raw)) + 1):
            c = raw[-i]
            if c & 0xC0 != 0x80:
                return i == (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
        return False

    def _shared(self, ids, at, mid, at_mid, low, high, safe, which):
        """(tokens before the edge in ids, in mid) of an edge between bytes low and high that both have; None without one.

        An edge is a byte offset where both encodings have a token's end, with the same
        tokens on both sides, and that is safe: either a word ends there in any case,
        so that what lies beyond it does not matter, or it is in the middle of a word.
        There the tokens on both sides are neighbours in an encoding, and a sequence
        of tokens is the encoding of its word if all neighbours are.
        """
        if len(ids) < 2 or len(mid) < 2:
            return None
        both, i, j = np.intersect1d(at[1:-1], at_mid[1:-1], return_indices=True)
        ok = (both >= low) & (both <= high) & (both < len(safe)) & (ids[i] == mid[j]) & (ids[i + 1] == mid[j + 1])
        k = np.flatnonzero(ok)
        k = k[safe[both[k]]]
        return (int(i[k[which]]) + 1, int(j[k[which]]) + 1) if len(k) else None

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """Concatenate encoded pieces pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.zeros(0, np.uint32)


def blob(ids) -> bytes:
    return np.asarray(ids).astype("<u4").tobytes()


def digest_row(codec: Codec, ids: np.ndarray, keep: bool):
    raw = blob(ids)
    text = codec.decode(ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), raw if keep else None


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary"


def result_batch(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])


def encode_whole(payload: str, keep: bool):
    """Encode texts of one piece."""

    def run(batches):
        codec = Codec("", payload)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                ids = part.column(0).to_pylist()
                yield result_batch([(d, *digest_row(codec, codec.encode(t or ""), keep)) for d, t in zip(ids, part.column(1).to_pylist(), strict=True)])
            K.trim()

    return run


def encode_pieces(payload: str):
    def run(batches):
        codec = Codec("", payload)
        for b in batches:
            for i in range(0, b.num_rows, 16):
                part = b.slice(i, 16)
                ids = [blob(codec.encode(t)) for t in part.column("piece").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), part.column("slot"), pa.array(ids, pa.binary())], ["doc_id", "row", "slot", "ids"])

    return run


def join_level(payload: str):
    """Join FAN neighbours pairwise; rows come sorted by row and slot, and all neighbours of a node are in one task."""

    def run(batches):
        codec = Codec("", payload)
        node, parts, doc = None, [], None

        def joined():
            return pa.RecordBatch.from_arrays(
                [pa.array([doc], pa.int64()), pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int32()), pa.array([blob(codec.tree(parts))], pa.binary())],
                ["doc_id", "row", "slot", "ids"],
            )

        for b in batches:
            for d, row, slot, ids in zip(*(b.column(k).to_pylist() for k in ("doc_id", "row", "slot", "ids")), strict=True):
                if node != (row, slot // FAN):
                    if node is not None:
                        yield joined()
                    node, parts, doc = (row, slot // FAN), [], d
                parts.append(np.frombuffer(ids, "<u4"))
        if node is not None:
            yield joined()

    return run


def digest_joined(payload: str, keep: bool):
    def run(batches):
        codec = Codec("", payload)
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                yield result_batch([(d, *digest_row(codec, np.frombuffer(x, "<u4"), keep))])

    return run


def bpe_round_trip(docs: DataFrame, vocabulary: str, keep_ids: bool = False, piece: int = PIECE) -> DataFrame:
    """Encode each text as the tokenizers library does with `vocabulary` (no special tokens added), and decode it again.

    Texts of up to `piece` characters are encoded at once.  Longer ones are cut
    into pieces that are encoded in parallel, and joined pairwise up a tree, three
    levels in one task: around each join a window is encoded again, growing until it
    agrees with both sides.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids
    (little-endian 32-bit).  Null texts count as empty; null and repeated ids are
    passed through, one row for each row; other columns are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        payload = f.read()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    payload_b = spark.sparkContext.broadcast(payload)  # one vocabulary file: its size does not grow with the data

    class Late:
        """The vocabulary, fetched where it is used."""

        def __init__(self, make, *rest):
            self.make, self.rest = make, rest

        def __call__(self, *args):
            return self.make(payload_b.value, *self.rest)(*args)

    def mapped(make, *rest):
        late = Late(make, *rest)

        def run(batches):
            yield from late(batches)
            K.trim()

        return run

    short = docs.where(F.length("text") <= piece).mapInArrow(mapped(encode_whole, keep_ids), RESULT)
    long = docs.where(F.length("text") > piece)
    n_long, most, size = long.agg(F.count(F.lit(1)), F.max(F.length("text")), F.sum(F.octet_length("text"))).first()
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    if not n_long:
        return short.select(*cols)
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / piece).cast("int"))
    # a row's number tells rows with one id apart; it is written before it is used
    rows = written(long.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.posexplode(F.transform(cuts, lambda i: F.substring(F.col("text"), (i * piece + 1).cast("int"), F.lit(piece)))).alias("slot", "piece")), "bpe-pieces")
    spread = rows.repartition(tasks_for(size), "row", "slot")
    level = written(spread.mapInArrow(mapped(encode_pieces), "doc_id bigint, row bigint, slot int, ids binary"), "bpe-level")
    discard(rows)
    n = -(-most // piece)
    while n > 1:
        near = level.repartition(tasks_for(size), "row", F.floor(F.col("slot") / FAN)).sortWithinPartitions("row", "slot")
        above = written(near.mapInArrow(mapped(join_level), "doc_id bigint, row bigint, slot int, ids binary"), "bpe-level")
        discard(level)
        level, n = above, -(-n // FAN)
    return short.select(*cols).unionByName(level.mapInArrow(mapped(digest_joined, keep_ids), RESULT).select(*cols))
