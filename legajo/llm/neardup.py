"""Problem 4: near-duplicate texts by a self-join of binary tries over similarity-preserving codes.

A text becomes the set of its three-word sequences, the set a min-hash signature of VALUES values, and the
signature a forest of BANDS binary tries. Band k's ROWS full values are the root of the text's path in
trie k; below it lies the same path for every trie: the lowest bit of each value (192 bits), then three
more bits of each (768 in all). Two sets of similarity J agree in a root with probability J^ROWS, and a bit
of their paths differs with probability (1 - J) / 2, while half of the bits of unrelated sets do.

The walk goes down pairs of nodes together. A root meets itself with no differing bit. A node pair with
more than LEAF classes on both sides is opened: the node table one stride deeper is joined with it, the
differing bits of the two children add up, and a child pair beyond the error budget of its depth is
dropped. A pair of small nodes is a pair of leaves, whose classes are compared along the rest of their
paths, at depth 64, 128, 192 and 768, and dropped at the first depth whose budget they exceed. Every level
is an equi-join on (root, prefix), so a root that many texts share is worked on node pair by node pair and
never by one task. What arrives at the end is tested exactly.

One trie of all texts would prune nothing before it has branched out (a quarter of the bits may differ,
half of them do by chance, and a trie of N texts is log2 N deep), which makes the walk quadratic; roots
with an error budget above 0 meet almost everything for the same reason. So the tries are partitioned by roots
of budget 0, as many as it takes to lose no pair, and the budget does its work below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import discard, materialize, spread, text_batches

SHINGLE = 3
SIMILARITY = 0.5
BANDS = 64
ROWS = 3
VALUES = BANDS * ROWS
#: Bits of each value on the path.
DIGIT = 4
#: Differing bits allowed at a depth: mean plus SIGMAS standard deviations at the wanted similarity.
SIGMAS = 4.1
#: Classes in a node up to which it is a leaf; bits by which a larger one is opened.
LEAF = 512
STRIDE = 8
#: Copies that stand together when pairs of copies are written; larger classes are cut into such blocks.
BLOCK = 500
#: Bits of the map of texts to be verified; its broadcast has at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(1, 2**63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]

#: A random number for each byte, and the powers by which a byte's place in the text counts, up and down.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_END = np.zeros(256, bool)
_END[[9, 10, 13, 32]] = True
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64, kept for the next text."""
    global _up, _down
    if len(_up) < n:
        steps = np.full(max(n, 1 << 16), _BASE, np.uint64)
        back = np.full(len(steps), pow(_BASE, -1, 2**64), np.uint64)
        steps[0] = back[0] = 1
        _up, _down = np.cumprod(steps), np.cumprod(back)
    return _up[:n], _down[:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (run of characters other than space, tab, CR and LF), from running sums over the text's bytes."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_END[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:-1], out=sums[1:])
    return (sums[stop] - sums[start]) * down[start]


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the k-word sequences of a text; empty for null and for fewer than k words."""
    h = word_hashes(text.lower()) if text else np.empty(0, np.uint64)
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h ^= h >> np.uint64(32)
    x = h[:n] * _P[0]
    for j in range(1, k):
        x = (x ^ (x >> np.uint64(29))) * _P[j % 5] + h[j : j + n]
    x ^= x >> np.uint64(32)
    x *= _P[1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def code(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root of each band, path in 64-bit words) of a set of sequence hashes; three words hold one bit of every value."""
    low = np.full(VALUES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 512):  # blocks that stay in the processor's cache
        v = s[i : i + 512, None] * _MUL
        v += _ADD
        v >>= np.uint64(16)
        np.minimum(low, v.min(axis=0), out=low)
    m = low * _P[0]
    m ^= m >> np.uint64(31)
    r = m.reshape(BANDS, ROWS)
    roots = np.arange(BANDS, dtype=np.uint64) * _P[2]
    for j in range(ROWS):
        roots = (roots ^ (roots >> np.uint64(27))) * _P[3] + r[:, j]
    bits = ((m[None, :] >> np.arange(13, 13 + DIGIT, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
    return roots.view(np.int64), np.packbits(bits).view(">u8").astype(np.uint64).view(np.int64)


def budget(values: int, bits: int = 1, similarity: float = SIMILARITY) -> int:
    """Differing bits allowed between two paths after `bits` bits of `values` values: bits of one value differ together."""
    j = similarity
    spread = values * ((1 - j) * bits / 4 + j * (1 - j) * bits * bits / 4)
    return int(np.ceil(values * (1 - j) * bits / 2 + SIGMAS * np.sqrt(spread)))


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, cls, size, roots, path) of texts (doc_id, text): cls is the same for equal sequence sets.

    Texts without a sequence are left out. Within a task only the first text of a class carries roots and path,
    so that many copies of a text are sent on as few.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for p in batches:
            rows = []
            for d, t in zip(p["doc_id"], p["text"]):
                s = shingles(t, k)
                if len(s):
                    c = int(np.int64(xxhash.xxh64_intdigest(s.tobytes()) - 2**63))
                    roots, path = (None, None) if c in seen else code(s)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(c)
                    rows.append((d, c, len(s), roots, path))
            yield pd.DataFrame(rows, columns=["doc_id", "cls", "size", "roots", "path"])

    return spread(docs.filter("text is not null")).mapInPandas(run, "doc_id string, cls long, size int, roots array<long>, path array<long>")


_HEAD = ("c0", "c1", "c2")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("c0", 64 - depth) if depth else F.lit(0).cast("long")


def _leaves(pairs: DataFrame, nodes: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(a, b, err): the classes of pairs of leaves (root, x, y), compared along the first 192 bits of their paths."""
    side = lambda k, n: nodes.select("root", _prefix(depth).alias(k), F.col("cls").alias(n), F.col("size").alias(f"{n}n"), *(F.col(c).alias(f"{n}{c}") for c in _HEAD))
    first = _differ("ac0", "bc0")
    second = first + _differ("ac1", "bc1")
    third = second + _differ("ac2", "bc2")
    # Sets of too different sizes can't be similar enough.
    near = (F.col("an") >= F.col("bn") * similarity) & (F.col("bn") >= F.col("an") * similarity)
    within = (first <= budget(64, 1, similarity)) & (second <= budget(128, 1, similarity)) & (third <= budget(192, 1, similarity))
    a, b = side("x", "a"), side("y", "b")
    if depth:
        met = pairs.join(a.hint("merge"), ["root", "x"]).join(b.hint("merge"), ["root", "y"]).filter(((F.col("x") != F.col("y")) | (F.col("a") < F.col("b"))) & near & within)
    else:  # a small root with itself
        met = a.join(b.drop("y").hint("merge"), "root").filter((F.col("a") < F.col("b")) & near & within)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), third.alias("err"))


def walk(sig: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF) -> DataFrame:
    """(a, b), a < b: pairs of classes whose paths stay within the error budget down to the end of some trie. sig: as signatures() gives it."""
    paths = sig.filter("path is not null").groupBy("cls").agg(F.first("size").alias("size"), F.first("path").alias("path"))
    paths = paths.select("cls", "size", *(F.col("path")[i].alias(c) for i, c in enumerate(_HEAD)), F.slice("path", 4, VALUES * DIGIT // 64 - 3).alias("rest"))
    roots = sig.select(F.explode("roots").alias("root"), "cls").repartition("root").dropDuplicates(["root", "cls"])
    shared = roots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("root"))).filter("n > 1")
    nodes = materialize(shared.join(paths.drop("rest").hint("merge"), "cls"), "nodes")
    found = [_leaves(nodes, nodes.filter(F.col("n") <= leaf), 0, similarity)]
    large = nodes.filter(F.col("n") > leaf)
    pairs = large.select("root").distinct().select("root", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("err"))
    for depth in range(STRIDE, 65, STRIDE):
        if pairs.isEmpty():
            break
        table = large.groupBy("root", _prefix(depth - STRIDE).alias("up"), _prefix(depth).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        kid = lambda up, at, n: table.select("root", F.col("up").alias(up), F.col("at").alias(at), F.col("n").alias(n))  # noqa: E731, B023
        down = pairs.join(kid("x", "kx", "nx"), ["root", "x"]).join(kid("y", "ky", "ny"), ["root", "y"]).filter("x < y or kx <= ky")
        down = down.withColumn("err", F.col("err") + _differ("kx", "ky") - _differ("x", "y")).filter(F.col("err") <= budget(depth, 1, similarity))
        down = materialize(down.select("root", F.col("kx").alias("x"), F.col("ky").alias("y"), "err", (F.col("nx") * F.col("ny")).alias("work")), "pairs")
        ends = F.lit(True) if depth == 64 else F.col("work") <= leaf * leaf
        found.append(_leaves(down.filter(ends).select("root", "x", "y"), large, depth, similarity))
        pairs = down.filter(~ends).select("root", "x", "y", "err")
    met = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("err").alias("err"))
    rest = lambda k: paths.select(F.col("cls").alias(k), F.col("rest").alias(f"r{k}")).hint("merge")
    below = F.aggregate(F.zip_with("ra", "rb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    out = materialize(met.join(rest("a"), "a").join(rest("b"), "b").filter(F.col("err") + below <= budget(VALUES, DIGIT, similarity)).select("a", "b"), "met")
    discard(nodes)
    return out


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids, with cls. A bit map of the ids (of fixed size, see FILTER_BITS) goes ahead of the join, so that few other texts are shuffled."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = ids.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("marks"))
    likely = docs.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(marks), "word").filter(F.getbit("marks", bit % 64) == 1)
    return likely.select("doc_id", "text").join(ids.hint("merge"), "doc_id")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the pairs whose sequence sets are similar enough, counted exactly. texts: (cls, text)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"), "a", "b")
    both = ends.join(texts.hint("merge"), "cls").groupBy("a", "b").agg(F.collect_list("text").alias("t")).filter("size(t) = 2")  # two texts a pair

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for a, b, (x, y) in zip(p["a"], p["b"], p["t"]):
                x, y = shingles(x, k), shingles(y, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                j = common / (len(x) + len(y) - common)
                if j >= similarity:
                    out.append((a, b, j))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    text_batches(pairs.sparkSession)
    return both.mapInPandas(run, "a long, b long, similarity double")


def link_classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links): (doc_id, cls), (cls, n, rep) and (a, b, similarity) between classes of different texts.

    docs: (doc_id, text). A class holds the texts with the same sequence set, however many, and takes part
    in the walk once; rep is its smallest id. Null texts and texts of fewer than k words are in no class.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    sig = materialize(signatures(docs, k), "signatures")
    pairs = walk(sig, similarity, leaf)
    members = materialize(sig.select("doc_id", "cls").distinct(), "members")
    discard(sig)
    classes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    speak = classes.join(ends.hint("merge"), "cls").select("cls", F.col("rep").alias("doc_id"))
    texts = _only(docs, speak).select("cls", "text").dropDuplicates(["cls"])
    links = materialize(verify(pairs, texts, similarity, k), "links")
    discard(pairs)
    return members, classes, links


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b), doc_id_a < doc_id_b: all pairs of the texts (doc_id, text) that are similar enough.

    Copies of a text are texts too: all their pairs are written, whatever their number, and a link of a text holds
    for each of its copies. The members of a class are cut into blocks of about `block`, and pairs of blocks
    are what the tasks share, so that no task holds a class. For copies as classes with their members
    instead of pairs see duplicate_groups() and class_links().

    A row that repeats an id counts once. Texts that differ only in case or white space are copies. Null
    texts and texts of fewer than k words are similar to nothing.
    """
    members, classes, links = link_classes(docs, similarity, k, leaf)
    blocks = F.ceil(F.col("n") / block).cast("int")
    of = lambda k: classes.select(F.col("cls").alias(k), blocks.alias(f"k{k}")).hint("merge")
    count = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    across = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").withColumn("i", count("ka")).withColumn("j", count("kb")).select("a", "i", "b", "j")
    inside = classes.filter("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), blocks.alias("k")).withColumn("i", count("k")).withColumn("j", count("k")).filter("i <= j").select("a", "i", "b", "j")
    tasks = across.unionByName(inside)
    ends = tasks.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    placed = materialize(members.join(classes.join(ends.hint("merge"), "cls").select("cls", blocks.alias("k")).hint("merge"), "cls").select("doc_id", "cls", F.pmod(F.xxhash64("doc_id"), "k").cast("int").alias("i")), "blocks")
    side = lambda c, i, x: placed.select(F.col("cls").alias(c), F.col("i").alias(i), F.col("doc_id").alias(x)).hint("merge")
    both = tasks.join(side("a", "i", "x"), ["a", "i"]).join(side("b", "j", "y"), ["b", "j"]).filter("x < y or (x > y and (a != b or i != j))")
    pairs = both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    # Only an id that comes with several texts can give a pair twice.
    return pairs if members.groupBy("doc_id").count().filter("count > 1").isEmpty() else pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (x, y): the smallest id reachable, by alternating neighbour minima and path halving.

    Each round is written to the shared folder, the one before it is deleted. It ends when no label changed.
    """
    both = materialize(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = materialize(both.select(F.col("x").alias("id")).distinct().withColumn("component", F.col("id")).withColumn("old", F.lit(None).cast(both.schema["x"].dataType)), "labels")
    while True:
        near = both.join(label, both.y == label.id).groupBy("x").agg(F.min("component").alias("m"))
        hop = label.join(near, label.id == near.x, "left").select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        up = label.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = materialize(hop.join(up, "c", "left").select("id", F.least("c", "cc").alias("component"), "old"), "labels")
        done = new.filter("component != old").isEmpty()
        discard(label)
        label = new
        if done:
            discard(both)
            return label.drop("old")


def class_links(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(class_a, class_b, similarity): similar enough classes of different texts by their smallest ids, class_a < class_b. Nulls as in similar_pairs()."""
    _, classes, links = link_classes(docs, similarity, k)
    rep = lambda c, x: classes.select(F.col("cls").alias(c), F.col("rep").alias(x))
    return links.join(rep("a", "x"), "a").join(rep("b", "y"), "b").select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, group_id, copies, links): one row per document; group_id is null for a text that is similar to no other.

    class_id: smallest id of the texts equal to it, copies: their number, itself included; links: other
    classes it is similar enough to (see class_links()). Both are its own id and 1 for a text in no class.
    """
    members, by, edges = link_classes(docs, similarity, k)
    group = components(edges.select(F.col("a").alias("x"), F.col("b").alias("y"))).withColumnRenamed("id", "cls")
    degree = edges.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    by = by.withColumnRenamed("n", "copies").join(group, "cls", "left").join(degree, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = by.groupBy("component").agg(F.min("rep").alias("group_id"), F.sum("copies").alias("total"))
    info = by.join(named, "component").select("cls", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("total") > 1, F.col("group_id")).alias("group_id"))
    return docs.select("doc_id").filter("doc_id is not null").distinct().join(members, "doc_id", "left").join(info, "cls", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), "group_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
