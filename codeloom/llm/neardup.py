"""Operator 6: near duplicates by bottom-k sketches.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets form a class; only the class with the smallest
doc_id goes on. Its sketch is the K smallest hashes of one hash function, the whole set if that is smaller.

Two sets with Jaccard >= 0.75 share 0.75 of the K smallest hashes of their union on average, and at least LEAST of them but for
about three pairs in a million at the threshold. So a document lists only its s - LEAST * s + 1 rarest sketch values in the
inverted lists: a linked pair meets in one of them. Values of common passages are the most frequent and drop out.

Pairs come from the lists in two rounds, neither of which emits all pairs of a list:

1. each member is held against its list's leader. Leaders are chosen by STARS hash functions, dealt to the lists by their value,
   so lists that hold about the same documents hold them against about STARS leaders in all. Pairs whose sketches estimate less
   than FLOOR are dropped (the same pairs that fall short of LEAST); the exact Jaccard of the full sets verifies the
   others, and the links' components follow;
2. lists whose members are still in several components are left. The members outside a list's largest component are held, in
   blocks, against the rest inside tasks, and only links that join components come out, for the exact check.

So a large group of near copies costs a few pairs for each member in round 1, few members remain for round 2, and nothing is capped.
The estimate counts values up to the smaller of the two sketches' largest ones: up to there both sets are known.

Null, empty and blank texts have empty sets and link with nothing; so do rows with null doc_id, whose component_id is null and which
are kept. Rows that repeat a doc_id share one component. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import Cache, map_texts, written

WORDS, K, LEAST, FLOOR, STARS = 5, 40, 0.425, 0.425, 6
THRESHOLD = (3, 4)  # Jaccard of 3/4
BLOCK, PAST, SLICE, PART = 1024, 256, 8192, 1024
BITS = 1 << 26  # of the filter for documents read again: at most BITS / 64 rows are broadcast
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | None, words_of: Cache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; words_of: hashes of words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * _ODD[0] + h[i : len(words) - n + 1 + i]
    out = (out ^ (out >> np.uint64(30))) * _ODD[1]
    out = (out ^ (out >> np.uint64(27))) * _ODD[2]
    return np.unique(out ^ (out >> np.uint64(31)))


def word_hashes() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest)


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), sketch (array of long, ascending as unsigned numbers)."""

    def make():
        hashed = word_hashes()

        def f(doc_ids, texts):
            sets = [shingles(t, hashed) for t in texts]
            return {"doc_id": doc_ids, "n_shingles": [len(s) for s in sets], "print": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:k].view(np.int64) for s in sets]}

        return f

    return map_texts(docs, "doc_id long, n_shingles long, print binary, sketch array<long>", make)


def _least(size):
    return F.greatest(F.lit(1), F.floor(size * LEAST)).cast("int")


def postings(classes: DataFrame) -> DataFrame:
    """value, doc, n: each class's rarest sketch values, as many as a linked pair needs to meet in one. Values of one class alone
    are counted but not listed."""
    each = classes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = each.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    met = each.join(common, "value").groupBy("doc", "n", "s").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("held"))
    keep = F.size("held") - _least(F.col("s")) + 1  # the s - size(held) values of one class come before these
    return met.where(keep > 0).select("doc", "n", F.explode(F.slice("held", F.lit(1), keep)).alias("x")).select(F.col("x.value").alias("value"), "doc", "n")


def _near_size(a, b):
    return (F.least(a, b) * THRESHOLD[1]) >= (F.greatest(a, b) * THRESHOLD[0])


def _leaders(lists: DataFrame) -> DataFrame:
    order = F.xxhash64("doc", F.pmod("value", F.lit(STARS)))
    return lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), "doc", "n")).alias("first"), F.count("*").alias("m"))


def first_pairs(lists: DataFrame) -> DataFrame:
    """a < b: each list's members with its leader."""
    met = lists.join(_leaders(lists).where("m > 1"), "value").where((F.col("first.doc") != F.col("doc")) & _near_size(F.col("first.n"), F.col("n")))
    return met.select(F.least("first.doc", "doc").alias("a"), F.greatest("first.doc", "doc").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """Pairs whose sketches leave a link possible."""
    key = F.transform("sketch", lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    s = classes.select("doc_id", key.alias("sketch"))
    both = pairs.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b")
    last = lambda c: F.when(F.size(c) < k, F.lit((1 << 63) - 1)).otherwise(F.element_at(c, F.lit(-1)))
    both = both.withColumn("t", F.least(last("x"), last("y"))).withColumn("shared", F.size(F.array_intersect("x", "y")))
    known = F.size(F.filter("x", lambda v: v <= F.col("t"))) + F.size(F.filter("y", lambda v: v <= F.col("t"))) - F.col("shared")
    return both.where(F.col("shared") >= FLOOR * known).select("a", "b")


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is in ids (doc), and a few others: a bit map of BITS bits, broadcast by words, keeps the texts of the rest
    out of the shuffle. Beyond some tens of millions of ids it lets more through; the exact join that follows drops them."""

    def place(c):
        bit = F.pmod(F.xxhash64(c), F.lit(BITS))
        return F.floor(bit / 64).alias("word"), F.expr("1L").alias("one"), F.pmod(bit, F.lit(64)).cast("int").alias("bit")

    words = ids.select(*place("doc")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask"))
    met = docs.select("*", *place("doc_id")).join(F.broadcast(words), "word")
    return met.where("(shiftright(mask, bit) & 1) = 1").drop("word", "one", "bit", "mask")


def sets_of(ids: DataFrame, docs: DataFrame, kind: type) -> DataFrame:
    """doc, set: the sorted distinct hashes of the documents in ids, or (uint32) their upper halves, which sort alike. The texts are
    read again."""
    texts = _perhaps(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), ids)

    def make():
        hashed = word_hashes()

        def f(doc_ids, texts):
            sets = [shingles(t, hashed) for t in texts]
            return {"doc": doc_ids, "set": [(s if kind is np.uint64 else np.unique((s >> np.uint64(32)).astype(np.uint32))).tobytes() for s in sets]}

        return f

    return map_texts(texts, "doc long, set binary", make).join(ids, "doc", "left_semi").dropDuplicates(["doc"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs whose full sets have the Jaccard; only documents in pairs are read again."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b"))).distinct()
    sets = written(sets_of(ids, docs, np.uint64), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def compare(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            keep = []
            for u, v in zip(x, y, strict=True):
                u, v = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(THRESHOLD[1] * both >= THRESHOLD[0] * (len(u) + len(v) - both) > 0)
            yield pa.RecordBatch.from_pydict({"a": pa.array([p for p, k in zip(a, keep, strict=True) if k], pa.int64()), "b": pa.array([p for p, k in zip(b, keep, strict=True) if k], pa.int64())})

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """doc, component (the smallest doc reachable) of every doc in links (a, b), by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def _links_in_lists(k: int):
    """For rows (value, i, c, role, doc, n, comp, listed, set) sorted by (value, i, c, role): holds the rows of role 0, at most
    about BLOCK, against each other (in slice 0) and against the rows of role 1, which stream past.

    Sketches are compared by one matrix product, sets (upper halves of the hashes, with room for two that collide) only where the
    estimate leaves a link possible, and only in one of the lists that a pair shares. That list hangs on the pair, so lists that
    hold about the same documents share their pairs evenly. Of the links between the rows only those that join components come out.
    """

    def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        values, at = np.unique(np.concatenate(x + y), return_inverse=True)
        cut = sum(map(len, x))
        met = np.zeros((2, len(values)), bool)
        met[0, at[:cut]], met[1, at[cut:]] = True, True
        met = met.all(axis=0)
        column = np.cumsum(met) - 1

        def held(each, at):
            out = np.zeros((len(each), int(met.sum()) or 1), np.float32)
            out[np.repeat(np.arange(len(each)), [len(v) for v in each])[met[at]], column[at[met[at]]]] = 1
            return out

        return held(x, at[:cut]) @ held(y, at[cut:]).T

    def upto(sketch: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
        """How many values of each sketch are known to both."""
        last = np.array([s[-1] if len(s) == k else np.iinfo(np.uint32).max for s in other])
        return np.stack([np.searchsorted(s, last, side="right") for s in sketch])

    def listed(rows: list[tuple]) -> np.ndarray:
        """The values in whose lists each row is, the present one repeated to equal length."""
        out = np.full((len(rows), max(len(r[7]) for r in rows)), rows[0][0], np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r[7])] = r[7]
        return out

    def here(x: np.ndarray, y: np.ndarray, pair: np.ndarray, value: int) -> np.ndarray:
        """Whether value is the one of the common values of x and y, row by row, that the numbers in pair choose."""
        keep = np.zeros(len(pair), bool)
        for at in range(0, len(pair), 4096):
            u, v = x[at : at + 4096], y[at : at + 4096]
            common = (u[:, :, None] == v[:, None, :]).any(axis=2)
            order = (u.view(np.uint64) ^ pair[at : at + 4096, None]) * _ODD[1]
            order = (order ^ (order >> np.uint64(29))) * _ODD[2]
            order[~common] = np.iinfo(np.uint64).max
            keep[at : at + 4096] = u[np.arange(len(u)), order.argmin(axis=1)] == value
        return keep

    def compare(one: list[tuple], two: list[tuple], parent: Cache, out: tuple[list, list]) -> None:
        if not one or not two:
            return
        value = one[0][0]
        (doc, n, comp), (doc2, n2, comp2) = ([np.array([r[c] for r in rows]) for c in (4, 5, 6)] for rows in (one, two))
        sets, sets2 = ([np.frombuffer(r[8], np.uint32) for r in rows] for rows in (one, two))
        sketch, sketch2 = [s[:k] for s in sets], [s[:k] for s in sets2]
        both = shared(sketch, sketch2)
        ok = (comp[:, None] != comp2) & (both >= FLOOR * (upto(sketch, sketch2) + upto(sketch2, sketch).T - both))
        ok &= np.minimum(n[:, None], n2) * THRESHOLD[1] >= np.maximum(n[:, None], n2) * THRESHOLD[0]
        if one is two:
            ok &= doc[:, None] < doc2
        at, at2 = np.nonzero(ok)
        if len(at):
            pair = (doc.view(np.uint64)[at] + doc2.view(np.uint64)[at2]) * _ODD[0]
            mine = here(listed(one)[at], listed(two)[at2], pair, value)
            at, at2 = at[mine], at2[mine]

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for a, b in zip(at.tolist(), at2.tolist(), strict=True):
            p, q = root(int(comp[a])), root(int(comp2[b]))
            if p != q:
                same = len(np.intersect1d(sets[a], sets2[b], assume_unique=True))
                size = int(n[a]) + int(n2[b])
                if THRESHOLD[1] * (same + 2) >= THRESHOLD[0] * (size - same - 2):
                    out[0].append(int(min(doc[a], doc2[b])))
                    out[1].append(int(max(doc[a], doc2[b])))
                    if THRESHOLD[1] * (same - 2) >= THRESHOLD[0] * (size - same + 2):
                        parent[p] = q  # certain

    def run(batches):
        out: tuple[list, list] = ([], [])
        key, held, passing, parent, inside = None, [], [], Cache(lambda c: c, 1 << 62), False

        def flush():
            nonlocal inside
            if key and key[2] == 0 and not inside:
                compare(held, held, parent, out)
            inside = True
            compare(held, passing, parent, out)
            passing.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != row[:3]:
                    flush()
                    key, held, inside = row[:3], [], False
                    parent.clear()
                if row[3] == 0:
                    held.append(row)
                else:
                    passing.append(row)
                    if len(passing) == PAST:
                        flush()
        flush()
        if out[0]:
            yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _blocks(lists: DataFrame, found: DataFrame) -> DataFrame:
    """value, i, c, role, doc, n, comp of the lists whose members are in several components.

    The largest component of a list needs no comparison inside itself. The others are dealt to blocks of about BLOCK. A block is
    held against the members of later blocks and of the largest component; slices of about SLICE of those go to different tasks,
    of about PART where there is one block only, whose copies then are no more than the list's rows.
    """
    named = lists.join(found, lists["doc"] == found["doc"], "left").select("value", lists["doc"], "n", F.coalesce("component", lists["doc"]).alias("comp"))
    sizes = named.groupBy("value", "comp").agg(F.count("*").alias("x")).groupBy("value").agg(F.sum("x").alias("m"), F.max(F.struct("x", "comp")).alias("top"), F.count("*").alias("comps"))
    others = F.col("m") - F.col("top.x")
    slices = F.ceil(F.col("m") / F.when(others <= BLOCK, PART).otherwise(SLICE)).cast("int")
    sizes = sizes.where("m > 2 and comps > 1").select("value", F.col("top.comp").alias("top"), F.ceil(others / BLOCK).cast("int").alias("blocks"), slices.alias("slices"))
    left = named.join(sizes, "value")
    own = F.when(F.col("comp") != F.col("top"), F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).otherwise(F.col("blocks"))
    left = written(left.withColumn("own", own).withColumn("slice", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("slices")).cast("int")).drop("top"), "left")
    held = left.where("own < blocks").select("value", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("c"), F.lit(0).alias("role"), "doc", "n", "comp")
    past = left.where("own > 0").select("value", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("slice").alias("c"), F.lit(1).alias("role"), "doc", "n", "comp")
    return held.union(past)


def other_pairs(lists: DataFrame, docs: DataFrame, found: DataFrame, k: int = K) -> DataFrame:
    """a < b of different components that share a list, and are linked but for colliding half hashes."""
    dealt = written(_blocks(lists, found), "dealt")
    listed = dealt.groupBy("doc").agg(F.collect_set("value").alias("listed"))
    members = listed.join(written(sets_of(dealt.select("doc").distinct(), docs, np.uint32), "sets"), "doc")
    rows = dealt.join(members, "doc").select("value", "i", "c", "role", "doc", "n", "comp", "listed", "set")
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "value", "i", "c").sortWithinPartitions("value", "i", "c", "role").mapInArrow(_links_in_lists(k), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    every = written(sketches(docs), "sketches")
    some = every.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    least = written(some.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    classes = some.join(least, (some["print"] == least["print"]) & (some["doc_id"] == least["rep"])).select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"])
    classes = written(classes, "sketches")
    lists = written(postings(classes), "lists")
    links = written(verified(written(estimated(first_pairs(lists), classes), "pairs"), docs), "links")
    found = components(links)
    more = written(other_pairs(lists, docs, found), "pairs")
    if not more.isEmpty():
        found = components(links.union(verified(more, docs)))
    named = least.join(found, least["rep"] == found["doc"], "left").select(F.col("print"), F.coalesce("component", "rep").alias("component_id"))
    out = every.join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
