"""N-gram Jaccard self-join by prefix trees, and its connected components.

1. Each text becomes its set of distinct shingles (64-bit hashes).  Equal sets are one class,
   found by a map-side combined grouping, however many copies there are.
2. Shingles have one global order: those not known to be frequent first, by hash, then the
   frequent ones, the rarest of them first.  Two sets with Jaccard similarity t or more share
   one of their first p = n - ceil(t*n) + 1 shingles, and at least m of their first p + m
   (one less than the bound that holds for the set whose prefix ends first, as the other's own m
   may be one more).  Of the prefixes of p + p/3 shingles, classes that do not share p/3
   with others are left out; no link is lost.
3. Tree joins.  Each prefix shingle that classes of like size share has a leader, the smallest of them.
   First each class goes to the leader that it shares the most shingles with, and the leader
   with it; then, for what is not in one component by now, to the leaders of all its shingles.
   Classes of one leader meet in blocks of bounded size (large groups are cut into chunks, small ones
   share a block).  In a block the sets, their shingles ordered by frequency, form a prefix tree
   with compressed edges; a probe goes down the tree and sets with a common beginning share one
   count of common shingles; a subtree ends where even all remaining shingles could not reach
   the threshold.  Every link is found by a tree; nothing is compared outside of it.
4. Links become components by star rounds, each written to the shared folder.  Written tables
   are deleted as soon as their last reader is written itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringtrace.llm.common import discard, slices, written
from ringtrace.llm.shingles import mixed, shingle_sets, shingles

#: Frequent shingles that the global order knows at most: it only orders, and drops nothing.
FREQUENT = 1_000_000
#: Shingles that a task counts at once.
COUNTED = 4_000_000
#: Members of a block at most, on average.
BLOCK = 512


def least_common(t: tuple[int, int], a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The fewest common shingles with which sets of sizes a and b link: ceil(t * (a + b) / (1 + t))."""
    return -(-(t[0] * (a + b)) // (t[0] + t[1]))


def prefix_size(n: int, t: tuple[int, int]) -> tuple[int, int]:
    """The shingles of a set's prefix, and how many of them it shares with any set that it links with."""
    p = n + (-t[0] * n) // t[1] + 1 if n else 0
    size = min(n, p + p // 3)
    return size, max(1, size - p)


def _frequent(docs: DataFrame, words: int) -> pa.Table:
    """h, n (hash and count) of shingles met twice or more by a task, the most frequent FREQUENT of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(COUNTED, np.uint64), 0

        def counted() -> pa.RecordBatch:
            own = held[:size]
            own.sort()
            # where runs of two or more begin and end
            same = np.concatenate([[False], own[1:] == own[:-1], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            begin, end = edges[::2], edges[1::2]
            return pa.RecordBatch.from_arrays([pa.array(own[begin].view(np.int64)), pa.array(end - begin + 1)], ["h", "n"])

        for batch in slices(batches):
            found = shingles(batch.column(0), words)[0]
            while len(found):
                some, found = found[: COUNTED - size], found[COUNTED - size :]
                held[size : size + len(some)] = some
                size += len(some)
                if size == COUNTED:
                    yield counted()
                    size = 0
        if size:
            yield counted()

    counts = docs.select("text").mapInArrow(rows, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 8")
    return counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()


class _Order:
    """The global order of shingles, from the counts of frequent ones."""

    BITS = 24

    def __init__(self, frequent: pa.Table):
        known, counts = frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
        at = np.argsort(known)
        self.known, self.counts = known[at], counts[at]

    def first(self, own: np.ndarray, size: int) -> np.ndarray:
        """The first ``size`` of a set whose shingles ascend."""
        if not len(self.known) or not size:
            return own[:size]
        if not hasattr(self, "maybe"):
            self.maybe = np.zeros(1 << self.BITS, bool)
            self.maybe[self.known >> np.uint64(64 - self.BITS)] = True
        asked = np.flatnonzero(self.maybe[own >> np.uint64(64 - self.BITS)])
        at = np.minimum(np.searchsorted(self.known, own[asked]), len(self.known) - 1)
        there = self.known[at] == own[asked]
        frequent, weights = asked[there], self.counts[at[there]]
        rare = np.delete(own, frequent) if len(frequent) else own
        if len(rare) >= size:
            return rare[:size]
        return np.concatenate([rare, own[frequent[np.lexsort((own[frequent], weights))]]])[:size]


def _longs(parts: list[np.ndarray]) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))


def shingled(docs: DataFrame, words: int, t: tuple[int, int]) -> DataFrame:
    """doc_id, n (shingles), f1, f2 (a fingerprint of the set), prefix: written."""
    known = docs.sparkSession.sparkContext.broadcast(_Order(_frequent(docs, words)))  # FREQUENT rows of 16 bytes at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = known.value
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), words)
            kinds = (pa.int64(), pa.int64(), pa.int64())
            numbers = [[len(x) for x in sets], [int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets], [int(mixed(x).sum(dtype=np.uint64).view(np.int64)) for x in sets]]
            prefixes = _longs([order.first(x, prefix_size(len(x), t)[0]) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(v, k) for v, k in zip(numbers, kinds)], prefixes], ["doc_id", "n", "f1", "f2", "prefix"])

    return written(docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n bigint, f1 bigint, f2 bigint, prefix array<bigint>"), "shingled")


def _needed(n: Column, t: tuple[int, int]) -> Column:
    """``prefix_size(n, t)[1]`` as a column."""
    p = n - F.expr(f"({t[0]} * n + {t[1] - 1}) div {t[1]}") + 1
    return F.greatest(F.lit(1), F.least(n, p + F.floor(p / F.lit(3))) - p)


def _bands(n: Column, t: tuple[int, int]) -> Column:
    """The two size bands of a set: sets that link differ by a factor of 1/t at most, and have one in common."""
    width = math.log(t[1] / t[0]) * (1 + 1e-6) if t[0] < t[1] else 1e-6
    band = F.floor(F.log(n) / F.lit(width)).cast("int")
    return F.array(band, band + 1)


def _shared(classes: DataFrame, t: tuple[int, int]) -> DataFrame:
    """rep, n, prefix of the classes that share as many prefix shingles as they need, of ``prefix`` only those shared: written."""
    tokens = classes.select("rep", "n", F.explode("prefix").alias("h"))
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    # a row holds no more than the class's own prefix
    return written(tokens.join(shared, "h", "left_semi").groupBy("rep", "n").agg(F.collect_list("h").alias("prefix")).filter(F.size("prefix") >= _needed(F.col("n"), t)), "shared")


def _leaders(tokens: DataFrame, t: tuple[int, int]) -> DataFrame:
    """rep, n, band, component, prefix (structs of h, leader) of the tokens (h, band, rep, n, component) that lie
    in two components or more, of classes that share as many of them in a band as they need: written.

    A leader is the smallest class of a shingle and band; two classes that link share ``need`` such
    shingles, and so a leader.
    """
    shared = tokens.groupBy("h", "band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("rep").alias("leader")).filter("a <> b").select("h", "band", "leader")
    kept = tokens.join(shared, ["h", "band"]).groupBy("rep", "n", "band", "component").agg(F.collect_list(F.struct("h", "leader")).alias("prefix"))
    return written(kept.filter(F.size("prefix") >= _needed(F.col("n"), t)), "leaders")


def _links_in_block(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, component: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of one group and different components: enough of them to join what is linked.

    Each set asks the tree for those of its group that are in another component by then and have not
    asked themselves (these have found it, if they link).
    """
    if len(np.unique(component)) < 2:
        return ids[:0], ids[:0]
    tree = _Tree(sets)
    label = np.unique(component, return_inverse=True)[1]
    asked = np.zeros(len(sets), bool)
    out: list[tuple[int, int]] = []
    for now in range(len(sets)):
        wanted = ~asked & (group == group[now]) & (label != label[now])
        asked[now] = True
        if not wanted.any():
            continue
        for other in tree.similar(sets[now], t, wanted).tolist():
            if label[other] != label[now]:
                out.append((now, other))
                label[label == label[other]] = label[now]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


class _Tree:
    """A prefix tree of sets with compressed edges, in arrays.

    Shingles are numbered by falling frequency in the block, so that beginnings are shared.
    Nodes are numbered from the root down, level by level; a node has its edge's shingles, its
    parent, its depth (shingles from the root) and the sizes of the least and largest set below.
    """

    #: Shingles of an edge at most, at the root; twice as many at each level down, so that a set of n has some log n nodes.
    EDGE = 16

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.known, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.known, -counts))] = np.arange(len(counts))
        self.rank, self.mark = rank, np.zeros(len(counts) + 1, np.uint8)
        sizes = np.array([len(s) for s in sets], np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        numbered = rank[inverse]
        rows = [np.sort(numbered[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.sizes = sizes
        self.levels: list[dict[str, np.ndarray]] = []
        # a node: sets [a, b) of the sorted order agree on their first ``depth`` shingles
        by = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())
        self.by = np.array(by, np.int64)
        ordered = [rows[k] for k in by]
        common = np.zeros(len(rows) + 1, np.int64)
        for k in range(1, len(rows)):
            x, y = ordered[k - 1], ordered[k]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            common[k] = differ[0] if len(differ) else m
        nodes, edge = [(0, len(rows), 0)], self.EDGE
        while nodes:
            level: dict[str, list] = {k: [] for k in ("parent", "depth", "least", "most", "first", "last")}
            edges: list[np.ndarray] = []
            after = []
            for parent, (a, b, depth) in enumerate(nodes):
                # children: runs whose neighbours agree beyond ``depth``; a set that ends here is a leaf of its own
                k = a
                while k < b:
                    e = k + 1
                    while e < b and common[e] > depth:
                        e += 1
                    own = ordered[k]
                    deep = min(len(own), int(common[k + 1 : e].min()) if e > k + 1 else len(own), depth + edge)
                    level["parent"].append(parent)
                    level["depth"].append(deep)
                    below = [len(ordered[i]) for i in range(k, e)]
                    level["least"].append(min(below))
                    level["most"].append(max(below))
                    level["first"].append(k)
                    level["last"].append(e)
                    edges.append(own[depth:deep])
                    after.append((k, e, deep))
                    k = e
            arrays = {k: np.array(v, np.int64) for k, v in level.items()}
            arrays["edges"] = np.concatenate(edges) if edges else np.zeros(0, np.int64)
            arrays["cuts"] = np.concatenate([[0], np.cumsum([len(x) for x in edges])]).astype(np.int64)
            arrays["whole"] = (arrays["least"] == arrays["most"]) & (arrays["depth"] == arrays["most"])
            self.levels.append(arrays)
            nodes = [(a, b, d) if not w else (a, a, d) for (a, b, d), w in zip(after, arrays["whole"])]
            edge *= 2
            if all(a == b for a, b, _ in nodes):
                break

    def similar(self, own: np.ndarray, t: tuple[int, int], wanted: np.ndarray) -> np.ndarray:
        """Positions of the wanted sets that link with the set ``own``."""
        mark = self.mark
        at = np.searchsorted(self.known, own)
        at = np.minimum(at, max(len(self.known) - 1, 0))
        there = self.known[at] == own if len(self.known) else np.zeros(len(own), bool)
        mine = np.sort(self.rank[at[there]])
        mark[mine] = 1
        n = len(own)
        counts, alive, found = np.zeros(1, np.int64), np.ones(1, bool), []
        alive_sets = np.concatenate([[0], np.cumsum(wanted[self.by])])
        for level in self.levels:
            parent = level["parent"]
            on = np.flatnonzero(alive[parent] & (alive_sets[level["last"]] > alive_sets[level["first"]]))
            new_alive, new_counts = np.zeros(len(parent), bool), np.zeros(len(parent), np.int64)
            if not len(on):
                break
            a, b = level["cuts"][on], level["cuts"][on + 1]
            size = b - a
            flat = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            sums = np.concatenate([[0], np.cumsum(mark[level["edges"][flat]], dtype=np.int64)])
            ends = np.cumsum(size)
            met = counts[parent[on]] + sums[ends] - sums[ends - size]
            # the most that can still be met: what the probe has beyond this edge, and the deepest set below
            last = np.where(size > 0, level["edges"][np.maximum(b - 1, 0)] if len(level["edges"]) else 0, -1)
            beyond = np.where(size > 0, len(mine) - np.searchsorted(mine, last, "right"), n)
            best = met + np.minimum(beyond, level["most"][on] - level["depth"][on])
            need = least_common(t, n, level["least"][on])
            fits = (best >= need) & (t[0] * n <= t[1] * level["most"][on]) & (t[0] * level["least"][on] <= t[1] * n)
            whole = level["whole"][on]
            hit = on[fits & whole & (met >= least_common(t, n, level["most"][on]))]
            for k in hit.tolist():
                found.append(self.by[level["first"][k] : level["last"][k]])
            going = fits & ~whole
            new_alive[on[going]] = True
            new_counts[on] = met
            counts, alive = new_counts, new_alive
        mark[mine] = 0
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        return out[wanted[out]]


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """node, component (the smallest node it is joined to) of undirected links (a, b) of bigint: written.

    Each round replaces the links by links of every node to the smallest node near it, first of
    larger neighbours, then of smaller ones, until every node has one target and no target has one
    itself; rounds grow with the logarithm of the longest chain.  A hot node's links are combined
    before each shuffle.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        loose = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if not edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() and not loose.count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the smallest near the node
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, written(small, "links")
        discard(before)


def _joined(members: DataFrame, sets: DataFrame, rows: int, t: tuple[int, int], block: int) -> DataFrame:
    """Links (a, b) among the members (group, rep, component) of each group, by the trees of blocks."""
    blocks = max(1, -(-rows // block))
    placed = members.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks))).select("block", F.xxhash64("group").alias("group"), "rep", "component")

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        own = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        a, b = _links_in_block(table.column("rep").to_numpy(), own, table.column("group").to_numpy(), table.column("component").to_numpy(), t)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.join(sets, "rep").groupBy("block").applyInArrow(links, "a bigint, b bigint")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, shingles (uint64 bytes) of the wanted doc_ids: written.  Rows that repeat an id are merged first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(batch.column(1), words)], pa.binary())], ["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(wanted, "rep", "left_semi")
    repeated = written(texts.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("rep"), "repeated")
    once, more = texts.join(repeated, "rep", "left_anti"), texts.join(repeated, "rep", "left_semi").groupBy("rep").agg(F.max("text").alias("text"))
    out = written(once.unionByName(more).mapInArrow(rows, "rep bigint, shingles binary"), "sets")
    discard(repeated)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of ``docs`` (doc_id, text; other columns are ignored), for Jaccard similarity of at least ``threshold``.

    A text of fewer words than ``words`` is one shingle, the whole; a null or empty text has none and
    links with nothing.  component_id is the smallest doc_id that links reach.  A null doc_id is
    kept, linked with nothing.  Rows that repeat a doc_id are one document and should repeat its text; all
    are kept.  Texts of any length are read whole.  An empty table gives an empty one.
    """
    spark, t = docs.sparkSession, threshold
    rows = shingled(docs, words, t)
    keyed = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # any member's prefix will do: equal sets have equal prefixes
    classes = written(keyed.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("prefix").alias("prefix")), "classes")
    whole = _shared(classes, t)
    banded = whole.select("rep", "n", F.col("rep").alias("component"), F.explode(_bands(F.col("n"), t)).alias("band"), "prefix").select("rep", "n", "component", "band", F.explode("prefix").alias("h"))
    tokens = _leaders(banded, t)
    discard(whole)
    led = tokens.select("rep", F.explode("prefix.leader").alias("leader"))
    sets = _sets(docs, written(tokens.select("rep").distinct(), "members"), words)

    # each class with the leader that it shares the most shingles with, in chunks; the leader is in every chunk
    met = led.filter("rep <> leader").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("c"))
    asked = written(met.groupBy("rep").agg(F.max_by("leader", F.struct("c", F.negative("leader"))).alias("leader")), "asked")
    sizes = asked.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    chunks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    chunked = asked.join(sizes, "leader").select("leader", "rep", F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"))
    first = sizes.select("leader", F.col("leader").alias("rep"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    members = chunked.unionByName(first).select(F.struct("leader", "chunk").alias("group"), "rep", F.col("rep").alias("component"))
    found = written(_joined(members, sets, 2 * asked.count(), t, block), "links")
    joined = components(found, spark)

    # what is not in one component by now meets under the leaders of all its shingles
    named = tokens.drop("component").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    left = _leaders(named.select("rep", "n", "band", F.coalesce("component", "rep").alias("component"), F.explode("prefix.h").alias("h")), t)
    discard(tokens, asked)
    held = written(left.select("rep", "component", F.explode(F.array_distinct("prefix.leader")).alias("leader")).distinct(), "held")
    discard(left)
    sizes = held.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    # every chunk of a leader meets every other, and itself, in the group (i, j) with i <= j
    numbered = held.join(sizes, "leader").withColumn("c", chunks).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda o: F.struct(F.least("k", o).alias("i"), F.greatest("k", o).alias("j")))
    members = written(numbered.select("leader", "rep", "component", F.explode(others).alias("b")).select(F.struct("leader", "b.i", "b.j").alias("group"), "rep", "component"), "members")
    found = written(found.unionByName(_joined(members, sets, members.count(), t, block)), "links")
    discard(held, members, sets)
    joined = components(found, spark)

    named = written(classes.join(joined, classes["rep"] == joined["node"], "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")), "named")
    discard(classes, found, joined)
    out = rows.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).cast("bigint")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
