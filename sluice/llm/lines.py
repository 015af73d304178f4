"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A text is its lines; blank ones end no chunk and open none.  A rolling hash runs over the hashes of lines, two at a time.
Boundaries of chunks are of two kinds, both given by the lines around them and never by their places, so lines inserted
before a passage don't shift its chunks:

* where the rolling hash occurs nowhere else in the table: there the text goes on in a way of its own, so a passage that
  is shared begins and ends there whatever surrounds it;
* inside such a stretch, where the rolling hash is the least of the ``REACH`` windows on either side: a change in
  one line of a long stretch leaves the chunks on both sides of it as they were.

A chunk has two lines or more.  Chunks are counted over the whole table by their hash and compared by their bytes, and one
that has an earlier equal (by document id, then line) is removed whole; the first one stays whole, so what is removed
is left somewhere as a chunk.  With ``passage`` a single line of so many words is a chunk of its own, inside another chunk or
not; shorter single lines never go.

Counting is partially aggregated, so a window or chunk may occur in any share of the documents; places of a
frequent chunk meet its first place by a salted join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WORD, bound, cut, numbered, release

#: What the hash of the earlier line of a window is multiplied by, and the windows on either side of which a boundary is the least.
BASE, REACH = 2**31 - 1, 2
#: The rolling hash by which boundaries are chosen: earlier line times ``TIMES`` plus later line, modulo a prime below 2^32.
TIMES, PRIME = 31, 4_294_967_291
#: Rows (ids and hashes of some 30 bytes) up to which a table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 300_000
#: A text is hot from this many places and this share of all places on (so at most 100,000 are), and its places are dealt to so many tasks.
HOT_PLACES, HOT_SHARE, SALTS = 1000, 1e-5, 64
INK = r"[^\x20\x09-\x0D]"


def rolled(before: Column, line: Column) -> Column:
    """Rolling hash of two lines that follow each other: 31 bits of each, so that their order counts."""
    bits = lambda s: F.shiftrightunsigned(F.xxhash64(s), 33)
    return bits(before) * F.lit(BASE) + bits(line)


def _inked(lines: Column) -> Column:
    """Numbers of the lines that aren't blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: F.get(lines, j).rlike(INK))


def windows(text: Column, passage: int | None = None) -> Column:
    """``array<struct<p, h>>``: each window of two lines by its number and rolling hash; none for null.

    A line of ``passage`` words stands beside them as ``-1`` less its number, with a negative hash.
    """

    def found(x: Column) -> Column:
        lines, full = x["lines"], x["full"]
        at = lambda j: F.get(lines, j)
        one = lambda p, h: F.struct(p.cast("int").alias("p"), h.alias("h"))
        rest = F.greatest(F.size(full) - 1, F.lit(0))
        two = F.zip_with(F.slice(full, F.lit(1), rest), F.slice(full, F.lit(2), rest), lambda a, b: rolled(at(a), at(b)))
        two = F.transform(two, lambda h, p: one(p, h))
        if passage is None:
            return two
        wide = F.filter(full, lambda j: (F.length(at(j)) >= 2 * passage - 1) & (F.regexp_count(at(j), F.lit(WORD)) >= passage))
        return F.concat(two, F.transform(wide, lambda j: one(-1 - j, -1 - F.shiftrightunsigned(F.xxhash64(at(j)), 1))))

    lines = F.split(text, "\n", -1)
    return F.when(text.isNotNull(), bound(lines, lambda ls: bound(F.struct(ls.alias("lines"), _inked(ls).alias("full")), found)))


def chunks(text: Column, repeated: Column) -> Column:
    """``array<struct<i, n>>``: first line and number of lines of each chunk, from the sorted numbers of the windows that repeat.

    Windows of consecutive numbers are a stretch; a window inside it that is least of its neighbours is where one chunk
    ends and the next begins.
    """
    piece = lambda i, n: F.struct(i.cast("int").alias("i"), n.cast("int").alias("n"))

    def cut_at(x: Column) -> Column:
        rep, hashes = x["rep"], x["hashes"]
        value = lambda p: F.pmod(F.get(hashes, p) * TIMES + F.get(hashes, p + 1), F.lit(PRIME))

        def inner(v: Column) -> Column:
            at = lambda t: F.get(v, t)
            near = lambda t, d: (t + d >= 0) & (at(t + d)["p"] == at(t)["p"] + d)
            less = lambda t, d: F.coalesce(near(t, d), F.lit(False)) & (at(t)["v"] < at(t + d)["v"])
            far = lambda t, d: ~F.coalesce(near(t, d), F.lit(False)) | (at(t)["v"] < at(t + d)["v"])

            def least(t: Column) -> Column:
                out = less(t, -1) & less(t, 1)
                for d in range(2, REACH + 1):
                    out = out & far(t, -d) & far(t, d)
                return out

            return F.transform(v, lambda w, t: F.struct(w["p"].alias("p"), least(t).alias("cut")))

        return bound(F.transform(rep, lambda p: F.struct(p.alias("p"), value(p).alias("v"))), inner)

    def joined(x: Column) -> Column:
        full = x["full"]

        def spans(w: Column) -> Column:
            beside = lambda u, v, d: F.coalesce(v["p"] == u["p"] + d, F.lit(False))
            goes_on = lambda u, v, d: beside(u, v, d) & ~F.coalesce(v["cut"], F.lit(True))
            opens = F.filter(w, lambda u, t: ~u["cut"] & ~goes_on(u, F.get(w, t - 1), -1))
            # Blank lines at a boundary inside a stretch belong to the chunk before it.
            closed = F.transform(w, lambda u, t: F.struct(u["p"].alias("p"), (~u["cut"] & ~goes_on(u, F.get(w, t + 1), 1)).alias("last"), beside(u, F.get(w, t + 1), 1).alias("inside")))
            ends = F.filter(closed, lambda u: u["last"])
            upto = lambda b: F.when(b["inside"], F.get(full, b["p"] + 2)).otherwise(F.get(full, b["p"] + 1) + 1)
            return F.zip_with(opens, ends, lambda a, b: piece(F.get(full, a["p"]), upto(b) - F.get(full, a["p"])))

        return bound(cut_at(x), spans)

    def found(x: Column) -> Column:
        lines = x["lines"]
        own = F.transform(F.filter(repeated, lambda p: p < 0), lambda p: piece(-1 - p, F.lit(1)))
        number = lambda j: F.conv(F.substring(F.md5(F.get(lines, j)), 1, 8), 16, 10).cast("long")
        parts = F.struct(x["full"].alias("full"), F.transform(x["full"], number).alias("hashes"), F.filter(repeated, lambda p: p >= 0).alias("rep"))
        return F.concat(bound(parts, joined), own)

    return bound(F.split(text, "\n", -1), lambda ls: bound(F.struct(ls.alias("lines"), _inked(ls).alias("full")), found))


def written(text: Column, i: Column, n: Column) -> Column:
    """Lines ``i`` to ``i + n - 1`` of a text as they stand."""
    return F.array_join(F.slice(F.split(text, "\n", -1), i + 1, n), "\n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` less the chunks it repeats, and ``n_lines``, ``n_removed``.

    Null texts stay null, with 0 lines; an empty text is one empty line and stays; very long texts are taken whole.
    A text that loses all its lines becomes empty.  Rows equal in id and text are one document, so a repeated row
    keeps the same lines as its twin; ties of one id go by a hash of the text; a null id comes before all others.
    An empty table gives an empty result.  Columns of other names are passed on, whatever they are, except that
    columns called ``n_lines`` and ``n_removed``, in any case, are replaced.
    """
    plain, column = numbered(docs)
    whole = column(text).cast("string")
    keyed = plain.withColumns({"k1": F.coalesce(column(key).cast("long"), F.lit(-(2**63))), "k2": F.xxhash64(column(text)), "whole": whole})
    parts = keyed.select("k1", "k2", F.explode(windows(F.col("whole"), passage)).alias("c")).select("k1", "k2", "c.p", "c.h")
    at = F.struct("k1", "k2", "p")
    counted = parts.select("h", at.alias("at")).groupBy("h").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    more = cut(counted.where("low <> high").select("h"), "repeated-hashes")
    small = more.count() <= BROADCAST_ROWS
    maybe = parts.join(F.broadcast(more) if small else more, "h").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("p")).alias("repeated"))
    stretches = cut(maybe, "repeated-windows")
    few = stretches.agg(F.coalesce(F.sum(F.size("repeated") + 4), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS
    texts = keyed.select("k1", "k2", "whole").join(F.broadcast(stretches) if few else stretches, ["k1", "k2"])
    found = texts.select("k1", "k2", "whole", F.explode(chunks(F.col("whole"), F.col("repeated"))).alias("c")).select("k1", "k2", "c.i", "c.n", written(F.col("whole"), F.col("c.i"), F.col("c.n")).alias("chunk"))
    maybe = cut(found.select(F.xxhash64("chunk").alias("h"), "k1", "k2", "i", "n", "chunk"), "repeated-chunks")
    place = F.struct("k1", "k2", "i")
    first = cut(maybe.groupBy("h", "chunk").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("places")).where("low <> high").drop("high"), "first-chunks")
    hot = F.col("places") >= max(HOT_PLACES, int(HOT_SHARE * maybe.count()))
    frequent = F.broadcast(first.where(hot).select("h").distinct().withColumn("hot", F.lit(True)))
    salted = maybe.join(frequent, "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("k1", "k2", "i"), F.lit(SALTS)).cast("int")).otherwise(0))
    # A hash that is hot by one text spreads the others as well.
    spread = first.join(frequent, "h", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    later = salted.join(spread.select("h", "chunk", "salt", "low"), ["h", "chunk", "salt"]).where(place != F.col("low"))
    gone = later.groupBy("k1", "k2").agg(F.collect_set(F.struct("i", "n")).alias("runs"))
    gone = cut(gone.select("k1", "k2", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1)))).alias("gone")), "removed-lines")
    if gone.agg(F.coalesce(F.sum(F.size("gone") + 4), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS:
        gone = F.broadcast(gone)
    out = keyed.join(gone, ["k1", "k2"], "left").withColumn("lines", F.split("whole", "\n", -1))
    release(more, stretches, maybe, first)
    n_lines = F.when(F.col("whole").isNotNull(), F.size("lines")).otherwise(0).cast("long")
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda j: F.get(ls, j))
    kept = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(F.array_join(bound(F.col("lines"), left), "\n"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", text.lower())]
    return out.select(*map(column, names), kept, n_lines, n_removed).toDF(*names, text, "n_lines", "n_removed")
