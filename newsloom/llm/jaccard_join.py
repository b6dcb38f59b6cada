"""Prefix-tree join of word-shingle sets under a Jaccard threshold, reduced to components.

1. Documents of equal shingle sets form one class (an aggregate over a 128-bit digest); one head of each class goes on.
2. A global order of shingles puts frequent ones last. Frequency only steers the work: shingles met in several
   documents of one task are summed over tasks, and the most frequent of these, a bounded list, are broadcast.
3. Each head sends its prefix (its first n - ceil(t n) + 1 shingles in that order) to buckets of shingle hashes. Two
   sets that link share a prefix shingle, so they meet at that shingle, and so in the group of its first document.
4. In each group the first document is compared with the others; these links give components.
5. Groups that still hold several components are joined whole: all but their largest component probe the prefix tree
   of the group. A subtree that holds a probe's own component only is left at once, so what is linked already is never
   compared again. A probe gives a bounded number of candidates; where it has more, the next round, with the components
   found meanwhile, allows more, until no probe had to stop.
6. Candidates are verified over whole sets, again by walking prefix trees; a task gives out at most one link for each
   component that it joins.

A prefix tree (trie) holds ordered sets; all probes of a task walk it together. Sets with a common beginning share the
counts of its overlap with each probe, and a probe leaves a subtree as soon as what remains of it, or of the subtree's
sets, cannot reach the overlap that the threshold needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import give_back, join_ids, materialize, most_frequent, small, table
from newsloom.llm.words import mix, shingle_sets

PERCENT = 75
#: About so many shingles are ordered by frequency (16 bytes each in every task), and only those counted so often at
#: least; the others count as rare.
FREQUENT_SHINGLES, FREQUENT_FROM = 500_000, 8
#: Shingles counted so often are dealt to buckets by their documents too, since one of them can be in a third of all rows.
HOT_SHINGLE = 100_000
#: Shingles that a task has gathered before it gives out those met more than once.
GATHER = 2_000_000
#: Documents whose sets a task holds at once.
ROWS = 1000
#: Prefix shingles of one bucket, about.
BUCKET_ENTRIES = 1 << 18
#: Shingles of one task's probes or tree, about (8 bytes each); larger groups are cut into blocks that meet each other.
BLOCK_SHINGLES = 2_000_000
#: Candidates that a probe gives in the first round of a group; sixteen times as many in each next one, while any has more.
MOST = 256
#: Edges that one task contracts, about.
TASK_EDGES = 500_000
#: Cells of a task's table of probes by shingles.
CELLS = 1 << 22
#: Rows of a group's members go to every task up to this number (about 100 bytes each); beyond it the join shuffles.
BROADCAST_MEMBERS = 200_000


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles) of every row; and in rows of their own (n_shingles is null
    there) h, n: shingles met in several documents of one task."""
    names = ["doc_id", "n_shingles", "digest", "h", "n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            h, n = h[n > 1], n[n > 1]
            none = [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.array(n)], names)

        for batch in _parts(batches):
            sizes, digests = [], []
            for own in shingle_sets(batch.column(1)):
                sizes.append(len(own))
                digests.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                held.append(own)
                size += len(own)
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
            none = [pa.nulls(batch.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *none], names)
        yield flush()
        held = []
        give_back()

    return _slim(docs).mapInArrow(read, "doc_id long, n_shingles long, digest binary, h long, n long")


def frequent_shingles(counts: DataFrame, limit: int = FREQUENT_SHINGLES) -> pd.DataFrame:
    """counts: h, n. The most frequent shingles, about `limit` at most: h, n, rank (1: least frequent), ascending by h."""
    some, _ = most_frequent(counts.where(F.col("n") >= FREQUENT_FROM), "h", "n", limit)
    top = some.toArrow().to_pandas().sort_values(["n", "h"])  # about `limit` rows at most
    top["rank"] = np.arange(1, len(top) + 1)
    return top.sort_values("h")


class GlobalOrder:
    """Ordered sets: rare shingles by hash, then the frequent ones by frequency."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray):
        self.hashes, self.ranks = hashes, ranks

    def __call__(self, own: np.ndarray) -> np.ndarray:
        """own: ascending hashes. The same set as sortable keys: rare ones keep 63 bits of the hash, frequent ones get
        the top bit and their rank."""
        keys = own >> np.uint64(1)
        if len(self.hashes):
            at = np.searchsorted(self.hashes, own.view(np.int64))
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == own.view(np.int64)
            keys[hit] = self.ranks[at[hit]].astype(np.uint64) | np.uint64(1 << 63)
        return np.sort(keys)


class PrefixTree:
    """A trie over ordered sets, paths without branches compressed, walked by many probes at once.

    reduced: ascending arrays of numbers of an alphabet, without what no probe holds; sizes: of the whole sets; labels: the
    component of each set (a number). A node keeps the label that all its sets share, or -1. With prefixes, the reduced
    sets are prefixes of whole ones, and what lies beyond counts as shared as far as it can be.
    """

    def __init__(self, reduced: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int, prefixes: bool = False):
        self.order = sorted(range(len(reduced)), key=lambda i: reduced[i].astype(">u4").tobytes())
        self.percent, self.prefixes = percent, prefixes
        self.sizes, self.labels = sizes[self.order].astype(np.int64), labels[self.order]
        seqs = [reduced[i] for i in self.order]
        lens = np.array([len(s) for s in seqs], np.int64)
        common = np.zeros(len(seqs), np.int64)  # length of the beginning shared with the set before
        for i in range(1, len(seqs)):
            m = min(lens[i - 1], lens[i])
            differs = np.flatnonzero(seqs[i - 1][:m] != seqs[i][:m])
            common[i] = differs[0] if len(differs) else m
        #: (numbers of the edge, depth, first terminal, the one after the last, most numbers below, least and largest size, label, children)
        self.nodes: list[tuple] = []
        todo = [(0, len(seqs), 0, None)] if seqs else []
        while todo:
            low, high, depth, parent = todo.pop()
            end = int(lens[low]) if high - low == 1 else int(common[low + 1 : high].min())
            after = low
            while after < high and lens[after] == end:
                after += 1
            same = self.labels[low] if (self.labels[low:high] == self.labels[low]).all() else -1
            own = self.sizes[low:high]
            node = (seqs[low][depth:end], end, low, after, int(lens[low:high].max()) - end, int(own.min()), int(own.max()), same, [])
            if parent is not None:
                parent.append(len(self.nodes))
            self.nodes.append(node)
            if after < high:
                cuts = [after, *(np.flatnonzero(common[after + 1 : high] == end) + after + 1).tolist(), high]
                todo += [(x, y, end, node[8]) for x, y in zip(cuts, cuts[1:])]

    def needed(self, a: np.ndarray, b: int) -> np.ndarray:
        """The overlap of the reduced sets that sets of sizes a and b need to link, 1 at least. Over b it is least at one of
        the ends of any range: it grows, with prefixes up to a only, then falls."""
        need = -(-self.percent * (a + b) // (100 + self.percent))
        if self.prefixes:
            need = need + 1 - np.maximum(-(-self.percent * a // 100), -(-self.percent * b // 100))
        return np.maximum(need, 1)

    def walk(self, holds: np.ndarray, sizes: np.ndarray, labels: np.ndarray, joined: np.ndarray, going: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(set, probes) where the overlap suffices and the components differ. holds: number by probe, 0 or 1; sizes: of the
        whole probes; joined: a component's number by its label, going: whether a probe goes on. The caller may change both."""
        left = holds.sum(axis=0, dtype=np.int64) - np.cumsum(holds, axis=0, dtype=np.int32)
        sizes = sizes.astype(np.int64)
        todo = [(0, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))] if self.nodes else []
        while todo:
            at, probes, overlap = todo.pop()
            edge, _, low, after, below, least, largest, label, children = self.nodes[at]
            other = going[probes] if label < 0 else going[probes] & (joined[labels[probes]] != joined[label])
            probes, overlap = probes[other], overlap[other]
            if len(edge) and len(probes):
                overlap = overlap + (holds[edge, probes[0]].sum(dtype=np.int64) if len(probes) == 1 else holds[np.ix_(edge, probes)].sum(axis=0, dtype=np.int64))
                own = sizes[probes]
                best = overlap + np.minimum(left[edge[-1], probes], below)
                can = (best >= np.minimum(self.needed(own, least), self.needed(own, largest))) & (own * 100 >= self.percent * least) & (largest * 100 >= self.percent * own)
                probes, overlap = probes[can], overlap[can]
            if not len(probes):
                continue
            for k in range(low, after):
                own, size = sizes[probes], self.sizes[k]
                hit = probes[(overlap >= self.needed(own, int(size))) & (own * 100 >= self.percent * size) & (size * 100 >= self.percent * own)]
                hit = hit[joined[labels[hit]] != joined[self.labels[k]]]
                if len(hit):
                    yield k, hit
            todo += [(child, probes, overlap) for child in children]


def walk_group(probes: list[np.ndarray], probe_sizes: np.ndarray, probe_labels: np.ndarray, sets: list[np.ndarray], set_sizes: np.ndarray,
               set_labels: np.ndarray, percent: int, most: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """(probe, set) pairs, and whether there may be more. Both sides hold ascending arrays; labels are numbers from 0.

    most None: whole sets, and so many of their links that everything which links is joined, given what has equal labels.
    Else the arrays are prefixes, and the pairs are those that may link by these, `most` for each probe.
    """
    out: list[tuple[int, int]] = []
    alphabet = np.intersect1d(np.concatenate(probes), np.concatenate(sets)) if probes and sets else np.empty(0, np.uint64)
    if not len(alphabet):
        return out, False

    def reduce(own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(alphabet, own)
        at[at == len(alphabet)] = 0
        return at[alphabet[at] == own]

    tree = PrefixTree([reduce(s) for s in sets], set_sizes, set_labels, percent, most is not None)
    joined = np.arange(int(max(probe_labels.max(), set_labels.max())) + 1)
    more = False
    step = max(1, CELLS // len(alphabet))
    for first in range(0, len(probes), step):
        some = probes[first : first + step]
        holds = np.zeros((len(alphabet), len(some)), np.uint8)
        for i, own in enumerate(some):
            holds[reduce(own), i] = 1
        going, labels, given = np.ones(len(some), bool), probe_labels[first : first + step], np.zeros(len(some), np.int64)
        for k, hit in tree.walk(holds, probe_sizes[first : first + step], labels, joined, going):
            if most is None:
                while len(hit):
                    out.append((first + int(hit[0]), tree.order[k]))
                    joined[joined == joined[labels[hit[0]]]] = joined[tree.labels[k]]
                    hit = hit[joined[labels[hit]] != joined[tree.labels[k]]]
            else:
                over = given[hit] >= most
                going[hit[over]], more = False, more or bool(over.any())
                hit = hit[~over]
                given[hit] += 1
                out += [(first + i, tree.order[k]) for i in hit.tolist()]
    return out, more


def _prefix_blocks(heads: DataFrame, order, buckets: int, percent: int) -> DataFrame:
    """bucket, keys, docs, places: the prefix shingles of each batch, packed by bucket; places hold position and set size."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, hot = order.value
        ordered = GlobalOrder(hashes, ranks)
        for batch in _parts(batches):
            keys, owner, places = [], [], []
            for doc, own in zip(batch.column(0).to_numpy(), shingle_sets(batch.column(1)), strict=True):
                n = len(own)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                keys.append(ordered(own)[:keep])
                owner.append(np.full(keep, doc, np.int64))
                places.append(np.stack([np.arange(keep), np.full(keep, n)], axis=1).astype(np.int32))
            if not keys:
                continue
            key, owner, places = np.concatenate(keys), np.concatenate(owner), np.concatenate(places)
            with np.errstate(over="ignore"):
                spread = np.where(key >= np.uint64(hot), key + mix(owner.view(np.uint64)), key)
                bucket = (mix(spread) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            bucket, key, owner, places = bucket[by], key[by], owner[by], places[by]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = list(zip(edge, np.append(edge[1:], len(bucket)), strict=True))
            packed = [pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for x in (key, owner, places)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), *packed], ["bucket", "keys", "docs", "places"])
        give_back()

    return heads.mapInArrow(blocks, "bucket int, keys binary, docs binary, places binary")


def _meetings(blocks: DataFrame, hot: int) -> DataFrame:
    """k, doc_id, pos, n, first, pos1, n1: the prefix shingles that several documents have, each document's position of the
    shingle and size, and the same of the first of these documents."""

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
        docs = np.frombuffer(b"".join(rows["docs"]), np.int64)
        places = np.frombuffer(b"".join(rows["places"]), np.int32).reshape(-1, 2)
        by = np.lexsort((docs, keys))
        keys, docs, places = keys[by], docs[by], places[by]
        new = np.append(True, keys[1:] != keys[:-1])
        run = np.cumsum(new) - 1
        head, last = np.flatnonzero(new)[run], docs[np.append(new[1:], True)][run]
        many = (docs[head] != last) | (keys >= np.uint64(hot))
        head = head[many]
        return pd.DataFrame({
            "k": keys[many].view(np.int64), "doc_id": docs[many], "pos": places[many, 0], "n": places[many, 1],
            "first": docs[head], "pos1": places[head, 0], "n1": places[head, 1]})

    return blocks.groupBy("bucket").applyInPandas(meet, "k long, doc_id long, pos int, n int, first long, pos1 int, n1 int")


def _first_of_hot(met: DataFrame, hot: int) -> DataFrame:
    """met with the true first documents of hot shingles, which were dealt to several buckets."""
    is_hot = (F.col("k") < 0) & (F.col("k") >= hot - (1 << 64))
    firsts = met.where(is_hot).groupBy("k").agg(F.min(F.struct("doc_id", "pos", "n")).alias("f"))  # fewer rows than ordered shingles
    found = met.where(is_hot).drop("first", "pos1", "n1").join(F.broadcast(firsts), "k").select(
        "k", "doc_id", "pos", "n", F.col("f.doc_id").alias("first"), F.col("f.pos").alias("pos1"), F.col("f.n").alias("n1"))
    return met.where(~is_hot).unionByName(found)


def _may_link(percent: int):
    """The length and positional bounds for two sets that share a shingle at these positions."""
    best = F.least("pos1", "pos") + F.least(F.col("n1") - F.col("pos1"), F.col("n") - F.col("pos"))
    return best * (100 + percent) >= (F.col("n1") + F.col("n")) * percent


def _enough(percent: int):
    """Whether sets whose prefixes share `c` shingles can link. What two sets share lies in both prefixes up to where the
    first of these ends, and what comes after is in that set's remainder."""
    beyond = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    return (F.col("c") + F.greatest(beyond("n1"), beyond("n"))) * (100 + percent) >= (F.col("n1") + F.col("n")) * percent


def walk_groups(probes: DataFrame, members: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """walk_group over every group: a, b (doc_id of the probe and of the set), n1, n (their sizes), grp, more (whether the
    group has more).

    probes, members: grp, doc_id, root (the component); blocks: grp, pb, mb for groups that are cut into so many blocks of
    probes and of members by hashes of their documents, every block of probes meeting every block of members; sets:
    doc_id, size (of the whole set), set (ordered, packed; whole, or with `most` a prefix). A doc_id with several sets has
    them all on either side. Empty inputs give no rows.
    """
    spark = sets.sparkSession
    large = F.broadcast(blocks)  # no more rows than all groups have blocks
    at = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)).cast("int") - 1))
    probes = probes.join(large, "grp", "left").select(
        "grp", at(F.col("pb"), 1).alias("i"), every(F.col("mb")).alias("j"), F.lit(0).alias("side"), "doc_id", "root")
    members = members.join(large, "grp", "left").select(
        "grp", every(F.col("pb")).alias("i"), at(F.col("mb"), 2).alias("j"), F.lit(1).alias("side"), "doc_id", "root")
    rows = materialize(probes.unionByName(members))
    few = rows.count() <= BROADCAST_MEMBERS  # then the sets stay where they are until they go to their group
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sets.join(F.broadcast(rows) if few else rows, "doc_id").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])  # (set, size, root, doc_id) of either side
        now = None
        out: list[tuple[int, int, int, int, int, bool]] = []

        def finish() -> None:
            if held[0] and held[1]:
                _, label = np.unique(np.array([r[2] for side in held for r in side]), return_inverse=True)
                sizes = [np.array([r[1] for r in side]) for side in held]
                cut = len(held[0])
                pairs, more = walk_group([r[0] for r in held[0]], sizes[0], label[:cut], [r[0] for r in held[1]], sizes[1], label[cut:], percent, most)
                out.extend((held[0][i][3], held[1][j][3], held[0][i][1], held[1][j][1], now[0], more) for i, j in pairs)
            for side in held:
                side.clear()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], pa.int64() if k < 5 else pa.bool_()) for k in range(6)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "n1", "n", "grp", "more"])

        for batch in batches:
            own, size, grp, i, j, side, root, doc = (c.to_pylist() for c in batch.columns)
            for k in range(len(own)):
                key = grp[k], i[k], j[k]
                if key != now:
                    finish()
                    now = key
                held[side[k]].append((np.frombuffer(own[k], np.uint64), size[k], root[k], doc[k]))
            yield flush()
        finish()
        yield flush()
        give_back()

    return dealt.select("set", "size", "grp", "i", "j", "side", "root", "doc_id").mapInArrow(
        walk, "a long, b long, n1 long, n long, grp long, more boolean")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node reachable from each, where that is another."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, least[x], low)
        np.minimum.at(least, least[y], low)
        while (jumped := least[least]).tolist() != least.tolist():
            least = jumped
        apart = least[x] != least[y]
        x, y = x[apart], y[apart]
    other = least != np.arange(len(nodes))
    return nodes[other], nodes[least[other]]


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """edges: a, b. node, root: the least node reachable, for every node of an edge that is not itself the root.

    Each task first contracts the edges it holds, `task_edges` about, to stars; where one task holds all, that is all.
    Else large-star and small-star steps alternate until the forest is made of stars; each round costs two shuffles of
    the remaining edges. Raises where `rounds` (about the square of the logarithm of the longest path) do not suffice.
    Edges with a null and loops are left out.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
        if held:
            a, b = _stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    both = materialize(both)
    tasks = max(1, -(-both.count() // task_edges))
    both = materialize(both.coalesce(tasks).mapInArrow(contract, "a long, b long"))
    if tasks == 1:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = None
    for _ in range(rounds):
        wide = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = wide.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = wide.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        both = materialize(small.where("a <> b").distinct())
        now = both.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == last:
            return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        last = now
    raise RuntimeError(f"components not found in {rounds} rounds")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT_SHINGLES, hot_shingle: int = HOT_SHINGLE,
                       block: int = BLOCK_SHINGLES, entries: int = BUCKET_ENTRIES, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (repeated rows too).

    Null texts and texts without words have no shingle and are their own component. A null doc_id is never linked and
    gets a null component. Rows that repeat a doc_id count as one document with several sets, all in one component. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    seen = materialize(scan(docs))
    digests = seen.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "digest")
    named = digests.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("head"), F.max("n_shingles").alias("n")))
    member = materialize(named.select("doc_id", "digest").join(classes, "digest").select("doc_id", "head").distinct())
    # a document that is no class's head is a copy in all its rows
    copies = materialize(member.where("doc_id <> head").select("doc_id").distinct().join(classes.select(F.col("head").alias("doc_id")), "doc_id", "left_anti"))
    top = frequent_shingles(seen.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")), frequent)
    hot = int(top["rank"][top["n"] >= hot_shingle].min()) if (top["n"] >= hot_shingle).any() else len(top) + 1
    hot |= 1 << 63
    order = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["rank"].to_numpy(np.int64), hot))
    sent = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    heads = join_ids(_slim(docs).where("doc_id IS NOT NULL"), copies, "doc_id", "left_anti")
    met = materialize(_meetings(_prefix_blocks(heads, order, max(32, int(sent) // entries), percent), hot))
    shared = _first_of_hot(met, hot) if (top["n"] >= hot_shingle).any() else met

    def ordered_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = GlobalOrder(*order.value[:2])
        for batch in _parts(batches):
            sets = [ordered(own) for own in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "size", "set"])
        give_back()

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs: a, b, n1, n (sizes). Links among them, as many as join all that they join; one probe a group."""
        ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
        sets = materialize(join_ids(heads, ids, "doc_id", "left_semi").mapInArrow(ordered_sets, "doc_id long, size long, set binary"))
        others = pairs.select(F.col("a").alias("grp"), F.col("b").alias("doc_id"), F.col("b").alias("root"))
        group = materialize(pairs.groupBy(F.col("a").alias("grp")).agg(F.ceil(F.sum("n") / block).alias("mb")))
        probes = group.select("grp", F.col("grp").alias("doc_id"), F.col("grp").alias("root"))
        return walk_groups(probes, others, group.where("mb > 1").select("grp", F.lit(1).alias("pb"), "mb"), sets, percent).select("a", "b")

    # every group's first document against the others; what is left out here comes again below
    near = shared.where("doc_id <> first").where(_may_link(percent)).groupBy("first", "doc_id", "n1", "n").agg(F.count("*").alias("c")).where(_enough(percent))
    near = materialize(near.groupBy(F.col("first").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n1").alias("n1"), F.max("n").alias("n")))
    several = member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    same = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    roots = materialize(components(verified(near).unionByName(same)))

    only = None
    while True:
        found = _candidates(shared, roots, only, percent, block, most)
        if found.isEmpty():
            break
        pairs = materialize(found.groupBy("a", "b").agg(F.max("n1").alias("n1"), F.max("n").alias("n")))
        of = lambda c: small(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")))
        new = components(verified(pairs).join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        outer = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
        roots = materialize(
            roots.join(small(outer), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            .unionByName(new.join(small(roots.select("node")), "node", "left_anti")))
        only = materialize(found.where("more").select("grp").distinct())
        if only.isEmpty():
            break
        most *= 16
    # a copy has its head's component; a document of several sets is in the one component of their heads
    where = member.groupBy("doc_id").agg(F.min("head").alias("head"))
    by_head = where.join(roots, where["head"] == roots["node"], "left").select("doc_id", F.coalesce("root", "head").alias("component"))
    return digests.join(by_head, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _candidates(shared: DataFrame, roots: DataFrame, only: DataFrame | None, percent: int, block: int, most: int) -> DataFrame:
    """a, b, n1, n: documents of different components that may link by the prefix shingles they share, `most` for each probe
    of a group; grp, more: whether the group has more. Of the groups in `only`, where that is given.

    At the first shingle that two linking sets share, the smaller one still has all the overlap needed before it, so it
    has the shingle among its first n - ceil(2 t n / (1 + t)) + 1; and the larger one is no smaller.
    """
    if only is not None:
        docs = shared.join(small(only.select(F.col("grp").alias("first"))), "first", "left_semi").select("doc_id").distinct()
        shared = join_ids(shared, materialize(docs), "doc_id", "left_semi")
    at = shared.select("k", "doc_id", "pos", "n", "first").join(small(roots.select(F.col("node").alias("doc_id"), "root")), "doc_id", "left").select(
        "k", "doc_id", "n", F.col("first").alias("grp"), F.coalesce("root", "doc_id").alias("root"),
        (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent))).alias("early"))
    smallest = F.min(F.when(F.col("early"), F.col("n"))).alias("smallest")
    mixed = materialize(at.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), smallest).where("lo <> hi").select("k", "smallest"))
    at = materialize(at.join(small(mixed), "k"))
    group = at.where("smallest IS NOT NULL AND (early OR n >= smallest)")
    group = materialize(group.groupBy("grp", "doc_id", "root").agg(F.max("n").alias("n")))
    sizes = group.groupBy("grp", "root").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).groupBy("grp").agg(
        F.max_by(F.struct("root", "n"), F.struct("docs", "root")).alias("largest"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    if only is not None:
        sizes = sizes.join(small(only), "grp", "left_semi")
    # all but the largest component of each group against all
    sizes = materialize(sizes.where("roots > 1").select(
        "grp", F.col("largest.root").alias("largest"), F.ceil((F.col("n") - F.col("largest.n")) / block).alias("pb"), F.ceil(F.col("n") / block).alias("mb")))
    group = materialize(group.join(small(sizes.select("grp", "largest")), "grp").drop("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.sort(np.array(k, np.int64).view(np.uint64)).tobytes() for k in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.binary())], ["doc_id", "size", "set"])

    # what documents of different components share, they share at mixed shingles
    own = join_ids(at, materialize(group.select("doc_id").distinct()), "doc_id", "left_semi")
    prefixes = own.groupBy("doc_id", F.col("n").cast("long").alias("size")).agg(F.collect_set("k").alias("keys")).mapInArrow(
        pack, "doc_id long, size long, set binary")
    return materialize(walk_groups(group.where("root <> largest"), group, sizes.where("mb > 1").drop("largest"), prefixes, percent, most))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_SETS = """
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM documents)"""
COMPONENTS_SQL = f"""
WITH RECURSIVE {_SETS.strip()},
r AS (SELECT DISTINCT a AS root, a AS node FROM e UNION SELECT r.root, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node) c USING (doc_id)"""
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLE_SQL = {"op6_jaccard_join": COMPONENTS_SQL}
