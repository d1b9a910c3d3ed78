"""SimHash near-duplicates with BK-trees.

Equal fingerprints are one node.  Two fingerprints within two bits agree on at
least two of four 16-bit blocks, so each goes to six shards, keyed by a pair of
blocks.  A shard is a BK-tree: children hang by their Hamming distance to the
parent, and a search follows only edges within the radius.  A shard reports a
spanning forest of its links, never all pairs; stars over the forest then give
the components.

The trees are built in the task that holds the shard instead of being broadcast:
their size follows the corpus, so a broadcast would have no bound.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import frugal, texts
from labelgrid.plans.materialize import discard, materialize, scratch

RADIUS = 2
SEED = 42
#: Fingerprints of a shard up to which a BK-tree is used; a larger one of op6 is split on its other bits, one of near copies scanned.
TREE = 1500

# The blanks that part words, and A-Z to a-z.
BLANKS = bytes([32, *range(9, 14)])
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str, words: int) -> np.ndarray:
    """Hashes of the runs of ``words`` words, repeats included; of all words if there are fewer."""
    parts = text.encode().translate(LOWERED).split()  # bytes split at the six ASCII blanks
    one = xxhash.xxh64_intdigest
    if not parts:
        hashes = []
    elif len(parts) < words:
        hashes = [one(b" ".join(parts), SEED)]
    elif words == 3:
        hashes = [one(b"%b %b %b" % p, SEED) for p in zip(parts, parts[1:], parts[2:])]
    else:
        hashes = [one(b" ".join(p), SEED) for p in zip(*(parts[k:] for k in range(words)))]
    return np.array(hashes, "<u8")


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; zero for no words."""
    return majority(shingles(text, words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype="int64") > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3) -> DataFrame:
    """``df`` (id, text) to ``id, fp`` (the fingerprint's bits as a signed long)."""

    def run(batches):
        for batch in batches:
            known = {}
            fps = []
            for t in texts(batch):
                if len(t) < 2000:
                    fps.append(known[t] if t in known else known.setdefault(t, fingerprint(t, words)))
                else:
                    fps.append(fingerprint(t, words))
            yield pa.record_batch([batch.column("id"), pa.array(np.array(fps, "uint64").view("int64"))], names=["id", "fp"])

    return df.select("id", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, fp long")


class BkTree:
    """Nodes by number; ``children[node]`` maps a distance to a node."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Insert a new value; the numbers of earlier ones within ``radius``."""
        values, children, mine = self.values, self.children, len(self.values)
        found, stack = [], [0] if values else []
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        node = 0 if values else None
        while node is not None:
            d = (values[node] ^ value).bit_count()
            node, parent = children[node].get(d), node
            if node is None:
                children[parent][d] = mine
        values.append(value)
        children.append({})
        return found


def shard_links(values: np.ndarray, free: int = 0xFFFFFFFFFFFFFFFF) -> list[tuple[int, int]]:
    """A spanning forest of the links (up to RADIUS bits) among distinct values.

    A shard too large for one tree splits three ways on the bits not yet fixed: within the radius, one
    third of them must be equal too.  With no bits left to split on, the tree takes all.
    """
    bits = [k for k in range(64) if free >> k & 1]
    if len(values) > TREE and len(bits) >= 6:
        out = []
        for third in np.array_split(np.array(bits), RADIUS + 1):
            mask = sum(1 << int(k) for k in third)
            key = values & np.uint64(mask)
            order = np.argsort(key, kind="stable")
            stops = np.flatnonzero(np.diff(key[order])) + 1
            for part in np.split(values[order], stops):
                if len(part) > 1:
                    out += shard_links(part, free & ~mask)
        return out
    return forest(values, RADIUS)


def forest(values: np.ndarray, radius: int, names: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links up to ``radius``, the closest first for each value.

    Rows of two words are one fingerprint of 128 bits.  A link gives the ``names`` of its ends, else the values.
    """
    tree, roots, out = BkTree(), [], []

    def root(k):
        while roots[k] != k:
            roots[k] = roots[roots[k]]
            k = roots[k]
        return k

    for n, v in enumerate(values.tolist() if values.ndim == 1 else [a | b << 64 for a, b in values.tolist()]):
        roots.append(n)
        found = tree.add_and_find(v, radius)
        for k in sorted(found, key=lambda k: (v ^ tree.values[k]).bit_count()) if radius > RADIUS else found:
            a, b = root(n), root(k)
            if a != b:
                roots[max(a, b)] = min(a, b)
                out.append((names[n], names[k]) if names else (v, tree.values[k]))
    return out


PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _by_shard(dealt: DataFrame, solve) -> DataFrame:
    """``a, b``: what ``solve(number, values)`` links in each shard; ``dealt``: rows of ``number, bits`` and the words of a fingerprint."""
    words = [c for c in dealt.columns if c not in ("number", "bits")]
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "number", "bits").sortWithinPartitions("number", "bits", "fp")

    def flush(keys, fps):
        stops = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], stops]), np.concatenate([stops, [len(keys)]])
        found = []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            found += solve(int(keys[a]) >> 32, fps[a:b] if len(words) > 1 else fps[a:b, 0])
        edges = np.array(found, "uint64").reshape(-1, 2).view("int64")
        return pa.record_batch([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["a", "b"])

    def run(batches):
        taken = lambda batch: np.stack([batch.column(c).to_numpy().view("uint64") for c in words], 1)
        keys, fps = np.empty(0, "int64"), np.empty((0, len(words)), "uint64")  # the shard not yet known to be complete
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column("number").to_numpy().astype("int64") << 32 | batch.column("bits").to_numpy()
            keys, fps = np.concatenate([keys, more]), np.concatenate([fps, taken(batch)])
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield flush(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield flush(keys, fps)

    return dealt.mapInArrow(frugal("simhash", run), "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp``, a spanning forest per shard."""
    block = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(n).alias("number"), (block(a) * 65536 + block(b)).alias("bits")) for n, (a, b) in enumerate(PAIRS)]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.col("k.number").alias("number"), F.col("k.bits").alias("bits"))

    def solve(number, values):
        fixed = sum(0xFFFF << (16 * k) for k in PAIRS[number])
        return shard_links(values, 0xFFFFFFFFFFFFFFFF & ~fixed)

    return _by_shard(dealt, solve)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of its component, for each node of an edge.

    Large and small stars in turn, each written out, until a round changes nothing (a few times the
    logarithm of the longest path).
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges, old = materialize(small.where("a <> b").distinct(), "stars"), edges
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fingerprint, component_id`` for every row.

    Fingerprints within two bits link; ``component_id`` is the smallest id that links reach, its own included.
    NULL and empty texts have fingerprint zero and link like any other.  Rows with a NULL id take part; a component
    of such rows alone has a NULL ``component_id``.  Repeated rows stay; an empty frame gives no rows.
    """
    docs = materialize(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), words), "fingerprints")
    nodes = materialize(docs.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    tree = components(links(nodes.select("fp")))
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return docs.join(label, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


# -- near copies by similarity -------------------------------------------------

#: Tables of sampled bits of the first word, and the radius over both words.  Copies of similarity 0.8 differ in some
#: 19 of 128 bits and share some table's bits in about 91 of 100 cases, those of 0.85 in 96, of 0.9 in 99 (simulated).
TABLES, TABLE_BITS, REACH = 96, 16, 32
SKETCH = 128
SIMILARITY = 0.8


def _table_bits(number: int) -> list[int]:
    return random.Random(1000 + number).sample(range(64), TABLE_BITS)


def _near(rows: np.ndarray) -> list[tuple[int, int]]:
    """Forest of a shard's nodes, rows of both words and the node; of those with equal words one is searched for the others."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    names = rows[:, 2].tolist()
    chain = [(names[k + 1], names[k]) for k in np.flatnonzero(same).tolist()]
    rows = rows[np.concatenate([[True], ~same])]
    return chain + (_scan(rows, REACH) if len(rows) > TREE else forest(rows[:, :2], REACH, rows[:, 2].tolist()))


def _scan(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Like ``forest``, for a shard too crowded for a tree: each row (two words, then its name) meets all not yet reached, in memory of its size."""
    names, out = values[:, 2].tolist(), []
    left = np.arange(1, len(values))
    todo = [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        k = todo.pop()
        away = np.bitwise_count(values[left, 0] ^ values[k, 0]) + np.bitwise_count(values[left, 1] ^ values[k, 1])
        near = away <= radius
        if near.any():
            found = left[near].tolist()
            out += [(names[n], names[k]) for n in found]
            todo += found
            left = left[~near]
    return out


def _rehashed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles: xor-shift and multiply, which numpy wraps at 64 bits."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``id, group_id``: documents whose shingles of ``words`` words are alike, by the group's smallest id.

    SimHash fingerprints of two words, the second of the same shingles hashed again, are sharded by sampled bits of the
    first; in a shard a BK-tree links each to the closest within REACH bits of both.  Where such links fail, all that hangs together by
    them is compared (see ``_searched``).  A link counts if the bottom sketches of both put their likeness at ``similarity`` or more (exact below
    SKETCH shingles); only texts with the same set of shingles (by a hash of 64 bits) are alike without a check.  Texts without words form
    one group; rows with a NULL id take part; repeated rows stay; an empty frame gives no rows.
    """

    def run(batches):
        for batch in batches:
            sets, fps, more, sketches = [], [], [], []
            for t in texts(batch):
                h = shingles(t, words)
                distinct = np.unique(h)
                sets.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                fps.append(majority(h))
                more.append(majority(_rehashed(h)))
                sketches.append(distinct[:SKETCH].view("i8"))
            yield pa.record_batch([batch.column("id"), *(pa.array(np.array(c, "uint64").view("int64")) for c in (sets, fps, more)), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "node", "fp", "more", "sketch"])

    kind = df.schema[id_col].dataType.simpleString()
    with scratch() as kept:  # the sketches go, the groups stay
        docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal("simhash", run), f"id {kind}, node long, fp long, more long, sketch array<long>")
        docs = materialize(docs, "sketched")
        # Repeats of words count in a fingerprint, not in the set: one set may have several, and the least stands for all.
        nodes = materialize(docs.groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("fp", "more", "sketch")).alias("s")).select("node", "first", "s.fp", "s.more", "s.sketch"), "nodes")

        def deal(batches):
            masks = [_table_bits(n) for n in range(TABLES)]
            for batch in batches:
                fps, rest = batch.column("fp").to_numpy(), (batch.column("more"), batch.column("node"))
                for n, bits in enumerate(masks):
                    key = sum((fps >> b & 1) << k for k, b in enumerate(bits))
                    yield pa.record_batch([pa.array(fps), *rest, pa.array(np.full(len(fps), n, "i4")), pa.array(key)], names=["fp", "more", "node", "number", "bits"])

        dealt = nodes.select("fp", "more", "node").mapInArrow(frugal("simhash", deal), "fp long, more long, node long, number int, bits long")
        edges = _by_shard(dealt, lambda number, rows: _near(rows)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("s_a"))
        right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("s_b"))
        judged = materialize(edges.join(left, "a").join(right, "b").select("a", "b", (_alike("s_a", "s_b") >= similarity).alias("alike")), "judged")
        tree = components(judged.where("alike").select("a", "b"))
        rooted = materialize(nodes.select("node", "first", "sketch").join(tree, "node", "left").select("node", "first", "sketch", F.coalesce("root", "node").alias("root")), "rooted")
        # A link that failed stands for others that the forest left out: what failed links hold together is searched again, by sketches.
        root = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        failed = judged.where("NOT alike").join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        more = components(_searched(rooted, components(failed), similarity))
        rooted = rooted.select("node", "first", "root").join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "first", F.coalesce("top", "root").alias("root"))
        label = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("group_id")), "root").select("node", "group_id")
        out = materialize(docs.select("id", "node").join(label, "node").select(F.col("id").alias(id_col), "group_id"), "near-copies")
        kept.append(out)
    return out


def _searched(rooted: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between the roots of each group whose members (``rooted``: ``root, sketch``) have sketches that are alike.

    A group of up to TREE members is one shard.  A larger one is dealt by the least hashes of its sketches: sketches that
    are alike share one of so many, or there would be more unlike hashes below their first common one than a likeness allows.
    """
    prefix = int((1 - similarity) * SKETCH) + 1
    whole = groups.union(groups.select(F.col("root").alias("node"), "root").distinct())  # components leave out the root itself
    members = rooted.join(whole.select(F.col("node").alias("root"), F.col("root").alias("part")), "root").select("part", "root", "sketch")
    sizes = members.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots")).where("roots > 1")
    keys = F.when(F.col("n") <= TREE, F.array(F.lit(0).cast("long"))).otherwise(F.slice("sketch", 1, prefix))
    dealt = members.join(sizes, "part").select("part", "root", "sketch", F.explode(keys).alias("key"))

    def solve(shard: pa.Table) -> pa.Table:
        lists = shard.column("sketch").combine_chunks()
        found = joined(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view("u8"), shard.column("root").to_numpy(), similarity)
        ends = np.array(found, "i8").reshape(-1, 2)
        return pa.table({"a": ends[:, 0].copy(), "b": ends[:, 1].copy()})

    return dealt.groupBy("part", "key").applyInArrow(solve, "a long, b long")


def joined(sizes: np.ndarray, hashes: np.ndarray, roots: np.ndarray, similarity: float, block: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``roots`` by sketches, given one after the other; the likeness is that of ``_alike``.

    Every member meets all that are not yet reached, so a group of copies takes one round and no failed pair hides a link.
    """
    names, cluster = np.unique(roots, return_inverse=True)
    if len(names) < 2:
        return []
    values, codes = np.unique(hashes, return_inverse=True)
    table = np.full((len(sizes), SKETCH), len(values), "i4")  # the code past the last is no hash
    table[np.arange(SKETCH) < sizes[:, None]] = codes
    order = np.argsort(cluster, kind="stable")
    of = np.split(order, np.cumsum(np.bincount(cluster))[:-1])
    mine, left, out = np.zeros(len(values) + 1, bool), np.ones(len(sizes), bool), []

    def alike(k, rows):
        mine[table[k, : sizes[k]]] = True
        below = np.cumsum(mine) - mine
        parts = []
        for at in range(0, len(rows), block):
            some = rows[at : at + block]
            hit = mine[table[some]]
            rank = np.arange(1, SKETCH + 1) + below[table[some]] - (np.cumsum(hit, axis=1) - hit)  # in the union
            union = np.minimum(sizes[k] + sizes[some] - hit.sum(axis=1), SKETCH)
            parts.append((hit & (rank <= SKETCH)).sum(axis=1) / np.maximum(union, 1) >= similarity)
        mine[table[k, : sizes[k]]] = False
        return np.concatenate(parts)

    for first in range(len(names)):
        if not left[of[first][0]]:
            continue
        left[of[first]] = False
        todo = of[first].tolist()
        while todo:
            rows = np.flatnonzero(left)
            if not len(rows):
                return out
            k = todo.pop()
            for c in np.unique(cluster[rows[alike(k, rows)]]).tolist():
                out.append((int(names[cluster[k]]), int(names[c])))
                left[of[c]] = False
                todo += of[c].tolist()
    return out


def _alike(a: str, b: str):
    """Jaccard estimate from two sketches (unsigned order; both ascending)."""
    flip = lambda x: F.transform(x, lambda h: h.bitwiseXOR(F.lit(-(2**63))))  # noqa: E731  signed order of unsigned hashes
    union = F.slice(F.sort_array(F.array_union(flip(a), flip(b))), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect(flip(a), flip(b)), union))
    return common / F.greatest(F.size(union), F.lit(1))
