"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.store import discard, written

#: fixed value: the separators of words
SPACE = " \t\n\x0b\x0c\r"
GRAM = 5
#: size partitions: a document's matching shingles are at most so many times the least item of the class
RATIOS = (2, 4)
#: the chance that MinHash misses a pair at the threshold is this at most, in each partition
MISS = 1e-6
#: parts that a frequent shingle's documents are dealt out over where its join is a shuffle
SALTS = 64
#: tables of up to this many bytes, as measured, are broadcast; larger ones are joined by shuffle
BROADCAST_BYTES = 32 << 20
#: bytes of a row beside its texts
ROW_BYTES = 64
#: bits of the sieve (8 MB), in rows of SIEVE_ROW bits
SIEVE_BITS, SIEVE_ROW = 1 << 26, 1 << 15


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; an empty array if it has none."""
    trimmed = F.btrim(F.lower(text), F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column) -> Column:
    """xxhash64 of every GRAM consecutive words, in order."""
    n = F.size(words) - GRAM
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(GRAM))))


def shingle_texts(words: Column) -> Column:
    n = F.size(words) - GRAM
    at = F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, GRAM), " ")))


def small(df: DataFrame, rows: int, texts: int = 0) -> DataFrame:
    """df, broadcast if its counted rows and the bytes of their texts are few."""
    return F.broadcast(df) if rows * ROW_BYTES + texts <= BROADCAST_BYTES else df


def sieved(seen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of seen whose h may be in the vocabulary: a bit map of all its hashes, of a fixed size, goes to every task.

    With a vocabulary of v hashes about v / SIEVE_BITS of the others pass.
    """
    bit = lambda h: F.pmod(h, F.lit(SIEVE_BITS))
    word = (F.pmod(bit(F.col("h")), F.lit(SIEVE_ROW)) / 64).cast("int")
    flag = F.expr("shiftleft(1L, cast(pmod(h, 64) as int))")
    words = vocabulary.select((bit(F.col("h")) / SIEVE_ROW).cast("int").alias("part"), word.alias("word"), flag.alias("flag"))
    words = words.groupBy("part", "word").agg(F.bit_or("flag").alias("flags"))
    filled = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "flags"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(SIEVE_ROW // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("bigint")))
    sieve = F.broadcast(filled.select("part", dense.alias("bits")))
    own = seen.withColumn("part", (bit(F.col("h")) / SIEVE_ROW).cast("int")).join(sieve, "part")
    return own.where(F.get("bits", word).bitwiseAND(flag) != 0).select(*seen.columns)


def minima_for(ratio: int, percent: int) -> int:
    """Minima that a pair at the threshold shares one of, but for a chance of MISS.

    An item of q shingles shares at least q * percent/100 with a set of at most
    ratio * q, which bounds their Jaccard similarity from below.
    """
    least = percent / 100 / (ratio + 1 - percent / 100)
    return 1 if least >= 1 else ceil(log(MISS) / log(1 - least))


def minima(sets: DataFrame, by: str, n: int) -> DataFrame:
    """by, class, k, m: n MinHash minima of each set of rows (by, class, h)."""
    least = sets.groupBy(by, "class").agg(*(F.min(F.xxhash64("h", F.lit(k))).alias(f"m{k}") for k in range(n)))
    return least.select(by, "class", F.posexplode(F.array(*(F.col(f"m{k}") for k in range(n)))).alias("k", "m"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of a document and a benchmark item with at least percent/100 of the item's 5-word shingles in the document.

    Items are classed by size (powers of two).  For each class, a document's set is
    those of its shingles that any item of the class has; if that is smaller than the
    least item needs, the document is out.  Sets are partitioned by their size in
    relation to the class, and in each partition enough MinHash minima are compared
    with the items' that a pair at the threshold is missed with a chance of MISS at
    most.  Sets larger than the last partition (documents with parts of many items)
    take an exact way: a document that lacks no more of an item's q shingles than the
    threshold allows has one of any q - need + 1 of them, and those in the fewest
    documents are looked up.  Candidates are verified on the shingles' texts over the
    whole document.

    Tables that follow from the items are broadcast up to BROADCAST_BYTES as measured;
    beyond that they are joined by shuffle, after a bit map of the items' shingles has
    taken out most of the documents' shingles.

    Returns doc_id, item_id, n_shared, n_shingles (of the item) and containment.
    Texts that are null or have fewer than five words have no shingles and match
    nothing; rows with a null id cannot be named and match nothing; rows that share
    an id count as one text each and are reported once, with the largest overlap.
    Other columns are ignored; empty tables give no pairs.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("t")).where("item_id is not null and t is not null")
    words = items.select("item_id", words_of(F.col("t")).alias("w"))
    grams = words.select("item_id", F.explode(shingle_hashes(F.col("w"))).alias("h")).distinct()
    sized = grams.groupBy("item_id").agg(F.count(F.lit(1)).alias("q"))
    # log2 of a power of two is exact in doubles; the class only has to be the same on both sides
    classed = grams.join(sized.select("item_id", "q", F.floor(F.log2("q")).cast("int").alias("class")), "item_id")
    vocabulary = classed.select("class", "h").distinct()
    n_vocabulary, n_grams = vocabulary.count(), grams.count()
    if not n_vocabulary:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_shared bigint, n_shingles bigint, containment double")

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("t")).where("doc_id is not null and t is not null")
    split = source.select("doc_id", words_of(F.col("t")).alias("w")).where(F.size("w") >= GRAM)
    seen = split.select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("h"))
    if n_vocabulary * ROW_BYTES <= BROADCAST_BYTES:
        hits = seen.join(F.broadcast(vocabulary), "h")
    else:
        dealt = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = sieved(seen, vocabulary.select("h")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(dealt, ["h", "salt"])
    hits = written(hits.select("doc_id", "class", "h"), "leak-hits")

    # an item of the class needs this many shingles at least
    need = F.ceil(F.expr("shiftleft(1L, class)") * percent / 100)
    sets = hits.select("doc_id", "class", "h").distinct().groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need)
    ratio = F.col("n") / F.expr("shiftleft(1L, class)")
    sets = written(sets.withColumn("part", sum((F.when(ratio > r, 1).otherwise(0) for r in RATIOS), F.lit(0))), "leak-sets")
    n_sets = sets.count()
    pairs = None
    for part, r in enumerate(RATIOS):
        own = hits.join(small(sets.where(F.col("part") == part).select("doc_id", "class"), n_sets), ["doc_id", "class"])
        n = minima_for(r, percent)
        met = minima(own, "doc_id", n).join(small(minima(classed, "item_id", n), sized.count() * n), ["class", "k", "m"]).select("doc_id", "item_id")
        pairs = met if pairs is None else pairs.unionByName(met)
    spread = hits.groupBy("class", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    ranked = classed.join(small(spread, n_vocabulary), ["class", "h"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n_docs", "h"))
    prefix = ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("q") - F.ceil(F.col("q") * percent / 100) + 1).where("n_docs > 0").select("item_id", "class", "h")
    large = hits.join(small(sets.where(F.col("part") == len(RATIOS)).select("doc_id", "class"), n_sets), ["doc_id", "class"])
    pairs = pairs.unionByName(large.join(small(prefix, n_grams), ["class", "h"]).select("doc_id", "item_id"))
    pairs = written(pairs.distinct(), "leak-candidates")
    discard(hits, sets)
    ids = pairs.select("doc_id").distinct()
    n_pairs, n_ids = pairs.count(), ids.count()

    texts = words.select("item_id", shingle_texts(F.col("w")).alias("g"))
    texts = texts.select("item_id", F.size("g").cast("bigint").alias("n_shingles"), F.explode("g").alias("gram"))
    r = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    again = split.join(small(ids, n_ids), "doc_id", "left_semi")
    # every row of a document is told apart, so that rows which share an id are not added up
    own_rows = again.select("doc_id", F.monotonically_increasing_id().alias("row"), shingle_texts(F.col("w")).alias("g"))
    found = own_rows.select("doc_id", "row", F.explode("g").alias("gram")).join(small(texts, *r), "gram")
    found = found.join(small(pairs, n_pairs), ["doc_id", "item_id"])
    shared = found.groupBy("doc_id", "row", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
    return best.select("doc_id", "item_id", "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))
