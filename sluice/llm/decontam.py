"""Benchmark decontamination: MinHash containment search over size partitions, in DataFrame functions only.

A document holds a test item when at least 80% of the item's distinct five-word shingles are among the
document's.  Short items in long documents have a tiny Jaccard similarity, so signatures of one fixed length
lose them.  Here a signature is all hash values of a set below a bound, and the bound follows the size partition
(a power of two) of the *item*: ``SKETCH`` by ``2^class`` of the range of hash values, so that an item's signature
has some 32 to 64 values, all of its values if it has fewer than 64 shingles.  A document has a signature in each
partition whose items it is large enough to hold, with the same bound; they are nested, so each hash value is
there once.  The share of an item's signature that is in the document's estimates the containment, whatever the
document's length.

Pairs whose estimate leaves room for 80% (for whole signatures the exact share, else five standard deviations less)
are verified once by their exact shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACES, bound, cut

N = 5
#: Containment, as hundredths.
PERCENT = 80
#: Values of a signature: this many by ``2^class`` of all hash values, so all for items of fewer shingles.
SKETCH = 64
#: Standard deviations that an estimate may be below 80%.
DEVIATIONS = 5
#: Signature rows (some 40 bytes each) and candidate pairs up to which a table is broadcast, and bytes of items; beyond, tables are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Tasks over which one hash value is spread where signatures are joined by shuffle.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), "")


def _starts(w: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - N, F.lit(0)))).otherwise(none)


def shingle_hashes(w: Column) -> Column:
    """A hash of each shingle; a text of fewer than five words is one shingle."""
    return bound(w, lambda w: F.transform(_starts(w), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(N)))))


def shingles(w: Column) -> Column:
    """The distinct shingles themselves."""
    return F.array_distinct(bound(w, lambda w: F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i + 1, F.lit(N)), " "))))


def size_class(n: Column) -> Column:
    """Size partition: the number of binary digits of the number of shingles."""
    return F.length(F.bin(n)).cast("int")


def in_signature(h: Column, item_class: Column) -> Column:
    """Whether a hash value belongs to signatures of a size partition."""
    digits = SKETCH.bit_length() - 1
    bounds = [min(2**63 - 1, -(2**63) + 2 ** (64 + digits - c) - 1) for c in range(64)]
    return h <= F.get(F.array(*map(F.lit, bounds)), item_class)


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment``: a row for each document and item it holds.

    Texts without words hold nothing and are held by nothing; an item of fewer than five words is held only
    by documents of those same words.  Rows of null ids take no part.  Rows of one document id are judged
    one by one, and the pair is returned once, with the largest share; rows of one item id are one item with
    the shingles of all.  Repeated rows change nothing.  Empty tables give an empty result.  Only ids and
    texts are read.
    """
    parts = items.select(items[item].alias("item_id"), words(items[text]).alias("w")).where(F.col("item_id").isNotNull())
    parts = parts.select("item_id", F.explode(F.arrays_zip(shingles(F.col("w")), F.array_distinct(shingle_hashes(F.col("w"))))).alias("x"))
    parts = parts.select("item_id", F.col("x")["0"].alias("shingle"), F.col("x")["1"].alias("h"))
    whole = cut(parts.groupBy("item_id").agg(F.collect_set("shingle").alias("shingles"), F.collect_set("h").alias("hs")), "items")
    m = F.size("shingles")
    least = F.ceil(m * PERCENT / 100).cast("int")
    sized = whole.select("item_id", m.alias("m"), least.alias("least"), size_class(m).alias("item_class"), F.explode("hs").alias("sign"))
    signature = sized.where(in_signature(F.col("sign"), F.col("item_class")))
    share = F.lit(PERCENT / 100)
    room = F.when(F.col("s") < F.col("m"), F.floor(share * F.col("s") - DEVIATIONS * F.sqrt(share * (1 - share) * F.col("s")))).otherwise(F.col("least"))
    needed = signature.groupBy("item_id", "m", "least").agg(F.count("*").alias("s")).select("item_id", F.greatest(room, F.lit(1)).alias("needed"))
    signature = cut(signature.join(needed, "item_id").select("item_id", "least", "needed", "sign"), "signatures")
    bytes_, rows = whole.agg(F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x))), F.lit(0)), F.coalesce(F.sum(m), F.lit(0))).first()
    few = rows <= BROADCAST_ROWS  # signatures are no more than shingles

    read = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    hashes = read.select("doc_id", F.array_distinct(shingle_hashes(words(F.col("text")))).alias("hs"))
    stream = hashes.select("doc_id", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    if few:
        met = stream.join(F.broadcast(signature), (F.col("h") == F.col("sign")) & (F.col("n") >= F.col("least")))
    else:
        salted = signature.withColumn("item_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        stream = stream.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        met = stream.join(salted, (F.col("h") == F.col("sign")) & (F.col("salt") == F.col("item_salt")) & (F.col("n") >= F.col("least")))
    pairs = met.groupBy("doc_id", "item_id", "needed").agg(F.count("*").alias("met")).where("met >= needed")
    pairs = cut(pairs.select("doc_id", "item_id"), "candidates")
    if pairs.count() <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    if few and bytes_ <= BROADCAST_BYTES:
        whole = F.broadcast(whole)
    shared = F.size(F.array_intersect(shingles(words(F.col("text"))), F.col("shingles"))).cast("long")
    found = read.join(pairs, "doc_id").join(whole, "item_id").select("doc_id", "item_id", m.cast("long").alias("n_item"), shared.alias("n_shared"))
    kept = found.where(F.col("n_shared") * 100 >= F.col("n_item") * PERCENT).groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return kept.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever their names; see :func:`contained`.

    Rows of a null id, null and empty texts stay; all rows of an id go if one of them holds an item.
    """
    held = cut(contained(docs, items, key=key, text=text).select("doc_id").distinct(), "held")
    held = held.select(F.col("doc_id").alias("_held"))
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    return docs.join(held, docs[key] == held["_held"], "left_anti")
