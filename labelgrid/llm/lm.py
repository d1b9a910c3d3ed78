"""Language-model scoring with a hashed maximum-entropy model.

The softmax is factored by classes: the probability of a word is that of its
class given the two words before it, times that of the word among its class given
the word before it.  Frequent words are classes of their own; the others share
classes by frequency and shape, and words that training never saw are one class.

Class logits add up features of hashed buckets of the words before: the last one,
the one before it (a skip), and their pair.  Features meet classes in a table of
fixed size, summed over all training tokens; gradient rounds run over its slices
on the executors.

In a class, a word's logit is its share of the class's tokens and the weight of
the hashed pair of the word before and the word.  There is a weight for each pair
that training has, so these grow with the corpus; they are never in one place:
pairs are dealt by the word before and the class, whose normaliser they share, and
each task runs the gradient rounds of its own and answers with sums by document.

Word counts come from all training documents, each distinct word of a block
being sent once, and each distinct pair of a block likewise.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm import blocks
from labelgrid.llm.common import frugal
from labelgrid.plans.materialize import materialize

VOCAB = 2  # a kind of rows, beside blocks.WORDS and blocks.PLACES
END = b"\n"
TOP, BINS, SHAPES = 80, 5, 8
CLASSES = 1 + TOP + BINS * SHAPES
BUCKETS, PAIRS = 128, 2048
ROUNDS = 12
#: Pseudo-counts in a step.
EASE = 5.0
#: Rounds for the pairs' weights, their Gaussian prior's precision, and the largest step.
PAIR_ROUNDS, PRIOR, STEP = 16, 0.2, 2.0
#: Bits of a pair's key that name the word; 32 more name the word before and the class.
WORD_BITS = 24
#: Tokens whose keys are made at once.
SLICE = 1 << 18

LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII blanks, then the end."""
    return [*text.encode().translate(LOWERED).split(), END]


def in_training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def _shape(word: bytes) -> int:
    last = word[-1]
    return (not word.isascii()) << 2 | (not (last >= 128 or 97 <= last <= 122)) << 1 | (last * 5 + word[0]) & 1


def _wide(counts: np.ndarray) -> list[bytes]:
    return [blocks.pack((counts & 0xFFFFFFFF).astype("u4")), blocks.pack((counts >> 32).astype("u4"))]


def _narrow(low: bytes, high: bytes) -> np.ndarray:
    return blocks.unpack(low).astype("i8") | blocks.unpack(high).astype("i8") << 32


def _count(batches):
    """Sums each word's training count over all blocks; answers the blocks and reports the vocabulary."""
    total, held, kind = {}, [], None
    for batch in batches:
        kind = batch.column("ids").type.value_type
        what = batch.column("kind").to_pylist()
        places = batch.filter(pa.array([k == blocks.PLACES for k in what], pa.bool_()))
        if places.num_rows:
            yield places
        for k, w in enumerate(what):
            if w == blocks.WORDS:
                raw = batch.column("body")[k].as_py()
                held.append((batch.column("block")[k].as_py(), batch.column("bucket")[k].as_py(), raw))
                _, names, counts = blocks.unbundle(raw)
                for name, c in zip(blocks.unpack_words(names), blocks.unpack(counts).tolist()):
                    total[name] = total.get(name, 0) + c
    if not held:
        return
    known = list(total.items())
    for at in range(0, len(known), 200_000):
        part = [x for x in known[at : at + 200_000] if x[1]]
        if part:
            yield blocks.rows([(0, -1, VOCAB, 0, _table(part), None)], kind)
    del known
    for block, bucket, raw in held:
        codes, names, _ = blocks.unbundle(raw)
        body = blocks.bundle(codes, _table([(w, total[w]) for w in blocks.unpack_words(names)]))
        yield blocks.rows([(0, block, blocks.WORDS, bucket, body, None)], kind)


def _table(part) -> bytes:
    """Counts, hashes and shapes of words."""
    counts = np.array([c for _, c in part], "i8")
    hashes = np.array([zlib.crc32(w) for w, _ in part], "u4")
    shapes = np.array([_shape(w) for w, _ in part], "u1")
    return blocks.bundle(*_wide(counts), blocks.pack(hashes), zstandard.compress(shapes.tobytes()))


def _read_table(raw: bytes):
    low, high, hashes, shapes = blocks.unbundle(raw)
    return _narrow(low, high), blocks.unpack(hashes), np.frombuffer(zstandard.decompress(shapes), "u1").astype("i8")


def _join_blocks(batches):
    """One row per block that holds all it needs: sizes, codes, and its words' table in the order of codes."""
    block, answers = None, []
    for batch in batches:
        kind = batch.column("ids").type.value_type
        for k in range(batch.num_rows):
            what, at = batch.column("kind")[k].as_py(), batch.column("block")[k].as_py()
            if what == VOCAB:
                yield batch.slice(k, 1)
                continue
            if at != block:
                block, answers = at, []
            body = blocks.unbundle(batch.column("body")[k].as_py())
            if what == blocks.WORDS:
                answers.append(body)
                continue
            n = struct.unpack("<I", body[2])[0]
            counts, hashes, shapes = np.zeros(n, "i8"), np.zeros(n, "u4"), np.zeros(n, "i8")
            for codes, table in answers:
                c = blocks.unpack(codes).astype("i8") - 1
                counts[c], hashes[c], shapes[c] = _read_table(table)
            table = blocks.bundle(*_wide(counts), blocks.pack(hashes), zstandard.compress(shapes.astype("u1").tobytes()))
            yield blocks.rows([(0, at, blocks.PLACES, 0, blocks.bundle(body[0], body[1], table), batch.column("ids")[k].as_py())], kind)


class Lexicon:
    """What all workers know of the vocabulary: totals, and the frequent words by (hash, count)."""

    def __init__(self, tokens: int, types: int, once: int, twice: int, top: list[tuple[int, int]]):
        self.tokens, self.types = tokens, types
        #: Share of words met once that stands for words never met (Good-Turing).
        self.unseen = once / (once + 2 * twice) if once else 0.0
        keys = np.array([c << 32 | h for h, c in top], "i8")
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.mass = None

    def rank(self, counts, hashes):
        """Place among the frequent words, or -1.  Beyond 2**31 occurrences the count keeps its low bits."""
        if not len(self.keys):
            return np.full(len(counts), -1)
        key = (counts & 0x7FFFFFFF) << 32 | hashes.astype("i8")
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (counts > 0), self.order[at], -1)

    def classes(self, counts, hashes, shapes):
        rank = self.rank(counts, hashes)
        level = np.searchsorted([2, 3, 8, 64], counts, "right")
        return np.where(counts == 0, 0, np.where(rank >= 0, 1 + rank, 1 + TOP + level * SHAPES + shapes))

    def buckets(self, counts, hashes):
        rank, half = self.rank(counts, hashes), BUCKETS // 2
        return np.where((rank >= 0) & (rank < half), rank, half + hashes.astype("i8") % (BUCKETS - half))


class Block:
    """A block's documents as arrays over tokens: ``word`` and the one before (``prev``) as numbers of the block's words, buckets of both words before."""

    def __init__(self, body: bytes, lexicon: Lexicon):
        sizes, codes, table = blocks.unbundle(body)
        self.counts, hashes, shapes = _read_table(table)
        self.sizes = blocks.unpack(sizes).astype("i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = word = blocks.resolve(blocks.unpack(codes), len(self.counts)).astype("i4")  # a token's numbers are many
        self.cls, bucket = (x.astype("i4") for x in (lexicon.classes(self.counts, hashes, shapes), lexicon.buckets(self.counts, hashes)))
        self.name = _mixed(hashes.astype("u8") << np.uint64(32) ^ self.counts.astype("u8"))
        end = word[self.sizes[0] - 1]  # a document follows the end of another
        self.prev = np.concatenate([[end], word[:-1]])
        before = np.concatenate([[end], self.prev[:-1]])
        before[self.starts] = end
        self.one, self.two = bucket[self.prev], bucket[before]

    def per_document(self, values):
        return np.add.reduceat(values, self.starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (numpy wraps the products)."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(32)


def pair_feature(one, two):
    return (one * 131 + two * 31) % PAIRS


class Model:
    """Weights of the classes: bias, last word, the word before it, their pair."""

    def __init__(self, bias):
        self.bias = bias
        self.one, self.two, self.pair = np.zeros((BUCKETS, CLASSES)), np.zeros((BUCKETS, CLASSES)), np.zeros((PAIRS, CLASSES))

    def log_probs(self, ones: np.ndarray) -> np.ndarray:
        """Natural log of the class probabilities: ones x BUCKETS x CLASSES."""
        twos = np.arange(BUCKETS)
        x = self.bias + self.one[ones][:, None, :] + self.two[None] + self.pair[pair_feature(ones[:, None], twos[None])]
        x -= x.max(axis=2, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=2, keepdims=True))


def _rows_of(found: DataFrame, kind: int) -> DataFrame:
    return found.where(F.col("kind") == kind)


def lexicon_of(found: DataFrame) -> Lexicon:
    """Totals over the vocabulary's rows; each row sends its TOP most frequent words."""

    def totals(batches):
        for batch in batches:
            for raw in batch.column("body"):
                counts, hashes, _ = _read_table(raw.as_py())
                top = np.lexsort((hashes, -counts))[:TOP]
                yield pa.record_batch([pa.array([int(counts.sum())]), pa.array([len(counts)]), pa.array([int((counts == 1).sum())]), pa.array([int((counts == 2).sum())]), pa.array([hashes[top].astype("i8").tolist()], pa.list_(pa.int64())), pa.array([counts[top].tolist()], pa.list_(pa.int64()))], names=["n", "v", "n1", "n2", "h", "c"])

    got = _rows_of(found, VOCAB).select("body").mapInArrow(totals, "n long, v long, n1 long, n2 long, h array<long>, c array<long>")
    sums = got.agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    top = got.select(F.explode(F.arrays_zip("h", "c")).alias("w")).select("w.h", "w.c").orderBy(F.desc("c"), "h").limit(TOP).collect()
    return Lexicon(sums.n or 0, sums.v or 0, sums.n1 or 0, sums.n2 or 0, [(r.h, r.c & 0x7FFFFFFF) for r in top])


def class_mass(found: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Training tokens of each class."""

    def mass(batches):
        for batch in batches:
            for raw in batch.column("body"):
                counts, hashes, shapes = _read_table(raw.as_py())
                sums = np.zeros(CLASSES, "i8")
                np.add.at(sums, lexicon.classes(counts, hashes, shapes), counts)
                yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(sums)], names=["k", "n"])

    got = _rows_of(found, VOCAB).select("body").mapInArrow(mass, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES)
    for r in got:
        out[r.k] = r.n
    return out


def feature_counts(found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``one, body``: for each last-word bucket, training tokens by bucket before it and class (a table of fixed size)."""

    def cells(batches):
        total = np.zeros(BUCKETS * BUCKETS * CLASSES)
        for batch in batches:
            for raw, ids in zip(batch.column("body"), batch.column("ids").to_pylist()):
                b = Block(raw.as_py(), lexicon)
                use = np.repeat(np.array([in_training(i) for i in ids], bool), b.sizes)
                place = (b.one * BUCKETS + b.two) * CLASSES
                rare = b.counts[b.word] == 1
                for pick, where, weight in ((use & ~rare, b.cls[b.word], 1.0), (use & rare, b.cls[b.word], 1 - lexicon.unseen), (use & rare, np.zeros_like(b.word), lexicon.unseen)):
                    if weight:
                        total += weight * np.bincount((place + where)[pick], minlength=len(total))
        body = total.reshape(BUCKETS, -1)
        for b in np.flatnonzero(body.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([b]), pa.array([zstandard.compress(body[b].tobytes())], pa.binary())], names=["one", "body"])

    def add(batches):
        sums = {}
        for batch in batches:
            for b, raw in zip(batch.column("one").to_pylist(), batch.column("body")):
                part = np.frombuffer(zstandard.decompress(raw.as_py()))
                sums[b] = sums[b] + part if b in sums else part
        for b, part in sums.items():
            yield pa.record_batch([pa.array([b]), pa.array([zstandard.compress(part.tobytes())], pa.binary())], names=["one", "body"])

    parts = _rows_of(found, blocks.PLACES).select("body", "ids").mapInArrow(frugal("lm", cells), "one long, body binary")
    return materialize(parts.repartition(16, "one").mapInArrow(frugal("lm", add), "one long, body binary"), "cells")


def _sums(cells: DataFrame, of) -> list[np.ndarray]:
    """Adds what ``of(ones, counts)`` gives for each task's slices: by last word, word before, pair."""

    def run(batches):
        sums = [np.zeros((BUCKETS, CLASSES)), np.zeros((BUCKETS, CLASSES)), np.zeros((PAIRS, CLASSES))]
        some = False
        for batch in batches:
            for b, raw in zip(batch.column("one").to_pylist(), batch.column("body")):
                some = True
                ones = np.array([b])
                x = of(ones, np.frombuffer(zstandard.decompress(raw.as_py())).reshape(1, BUCKETS, CLASSES))[0]
                sums[0][b] += x.sum(axis=0)
                sums[1] += x
                np.add.at(sums[2], pair_feature(b, np.arange(BUCKETS)), x)
        if some:
            yield pa.record_batch([pa.array([zstandard.compress(np.concatenate(sums).tobytes())], pa.binary())], names=["body"])

    out = np.zeros((2 * BUCKETS + PAIRS, CLASSES))
    # The table has a fixed size, and so has the work of a round: six tasks at any corpus size, each sending one table of sums.
    for r in cells.coalesce(6).mapInArrow(run, "body binary").collect():
        out += np.frombuffer(zstandard.decompress(r.body)).reshape(out.shape)
    return np.split(out, [BUCKETS, 2 * BUCKETS])


def train(cells: DataFrame, rounds: int = ROUNDS) -> Model:
    """Gradient ascent on the likelihood; each step divides the gradient by the counts it rests on."""
    seen = _sums(cells, lambda ones, n: n)
    prior = seen[0].sum(axis=0) + 0.5
    model = Model(np.log(prior / prior.sum()))
    mean = prior / prior.sum()
    # Start from the last word's own association with each class.
    model.one = np.log((seen[0] + 20 * mean) / (seen[0].sum(axis=1, keepdims=True) + 20)) - model.bias
    for _ in range(rounds):
        expected = _sums(cells, lambda ones, n, m=model: np.exp(m.log_probs(ones)) * n.sum(axis=2, keepdims=True))
        for weights, want, have in zip((model.one, model.two, model.pair), seen, expected):
            weights += 0.5 * (want - have) / (np.maximum(want, have) + EASE)
    return model


# -- words in their class -------------------------------------------------------


def pair_keys(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens ``at``: what their pairs are dealt by, and their keys (word before and class, then word)."""
    low, dealt, keys = np.uint64((1 << WORD_BITS) - 1), np.empty(len(at), "u4"), np.empty(len(at), "u8")
    for a in range(0, len(at), SLICE):
        some = at[a : a + SLICE]
        word = block.word[some]
        group = _mixed(block.name[block.prev[some]] + block.cls[word].astype("u8"))
        dealt[a : a + SLICE] = group >> np.uint64(32)
        keys[a : a + SLICE] = (group & np.uint64(0xFFFFFFFF)) << np.uint64(WORD_BITS) | block.name[word] & low
    return dealt, keys


def _pack_keys(keys: np.ndarray) -> list[bytes]:
    """Ascending keys, as steps."""
    return _wide(np.diff(keys.astype("i8"), prepend=0))


def _deal_pairs(found: DataFrame, lexicon: Lexicon, n: int) -> DataFrame:
    """Each block's distinct pairs of words that share a class: key, the word's count and class, training count, and the documents they are in."""

    def run(batches):
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for raw, number, ids in zip(batch.column("body"), batch.column("block").to_pylist(), batch.column("ids").to_pylist()):
                b = Block(raw.as_py(), lexicon)
                del b.one, b.two
                at = np.flatnonzero((b.cls > TOP)[b.word]).astype("i4")
                if not len(at):
                    continue
                part, key = pair_keys(b, at)
                part %= n
                order = np.argsort(key).astype("i4")
                order = order[np.argsort(part[order].astype("u2" if n <= 1 << 16 else "u4"), kind="stable")]
                part, key, at = part[order], key[order], at[order]
                del order
                doc = np.repeat(np.arange(len(b.sizes), dtype="i4"), b.sizes)[at]
                used = np.array([in_training(i) for i in ids], bool)[doc]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                times, trained = np.diff(first, append=len(at)), np.add.reduceat(used, first, dtype="i8")
                words = b.word[at[first]]
                counts, cls = b.counts[words], b.cls[words]
                cuts = np.flatnonzero(np.diff(part[first])) + 1
                lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(first)]])
                ends = np.append(first, len(at))
                out = []
                for x, y in zip(lo.tolist(), hi.tolist()):
                    body = blocks.bundle(*_pack_keys(key[first[x:y]]), *_wide(counts[x:y]), *(blocks.pack(v) for v in (cls[x:y], trained[x:y], times[x:y], doc[ends[x] : ends[y]])))
                    out.append((int(part[first[x]]), number, blocks.WORDS, 0, body, None))
                for k in range(0, len(out), 64):
                    yield blocks.rows(out[k : k + 64], kind)

    kind = found.schema["ids"].dataType.elementType.simpleString()
    return _rows_of(found, blocks.PLACES).mapInArrow(frugal("lm", run), blocks.schema(kind)).repartitionById(n, "key")


def fit_pairs(trained: np.ndarray, share: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of each pair's probability of its word in the class after the word before; pairs of a group follow each other.

    ``trained``: the pair's training count, ``share``: the word's share of its class, ``first``: where groups start.
    Gradient ascent on the penalised likelihood; a step is divided by a bound of the curvature.  Pairs that training
    does not have keep the weight 0.
    """
    size, seen = np.diff(first, append=len(trained)), trained > 0
    spread = lambda x: np.repeat(x, size)
    total = spread(np.add.reduceat(trained, first))
    rest = np.maximum(1 - np.add.reduceat(np.where(seen, share, 0.0), first), 1e-9)  # hashing may let shares exceed 1
    weight = np.zeros(len(trained))

    def normaliser():
        return spread(rest + np.add.reduceat(np.where(seen, share * np.exp(weight), 0.0), first))

    for _ in range(PAIR_ROUNDS):
        expected = total * share * np.exp(weight) / normaliser()
        weight += np.where(seen, np.clip((trained - expected - PRIOR * weight) / (expected + PRIOR), -STEP, STEP), 0.0)
    return np.log(share) + weight - np.log(normaliser())


def _fit_dealt(mass: np.ndarray):
    """Fits all pairs of a task and answers each block with log10 sums by document."""

    def run(batches):
        held, found, kind = [], [], None
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("body")):
                low, high, *rest = blocks.unbundle(raw.as_py())
                found.append((np.cumsum(_narrow(low, high)), _narrow(*rest[:2]), blocks.unpack(rest[2]), blocks.unpack(rest[3])))
                held.append((number, len(found[-1][0]), *rest[4:]))  # still packed
        if not held:
            return
        key, counts, cls, trained = (np.concatenate(c) for c in zip(*found))
        del found
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        first = np.flatnonzero(new)
        pair = np.empty(len(key), "i8")
        pair[order] = np.cumsum(new) - 1
        lead = order[first]
        group = key[lead] >> WORD_BITS
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        value = fit_pairs(np.add.reduceat(trained[order].astype("f8"), first), counts[lead] / mass[cls[lead]], starts)[pair] / np.log(10)
        del key, counts, cls, trained, order, new, first, pair, lead, group
        at = 0
        for number, size, times, doc in held:
            doc = blocks.unpack(doc)
            sums = np.bincount(doc, np.repeat(value[at : at + size], blocks.unpack(times)))
            at += size
            some = np.unique(doc)
            body = blocks.bundle(blocks.pack(some), zstandard.compress(sums[some].tobytes()))
            yield blocks.rows([(0, number, blocks.WORDS, 0, body, None)], kind)

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain`` of every whole text.

    Documents whose crc32 of the id as text leaves 1 modulo 5 are held out of training.  Scores are sums of log10
    probabilities, the end included; the base is the add-half unigram model; ``gain`` is what the score has over it a
    token.  A NULL or empty text is the end alone; a NULL id counts as the empty text; repeated rows train and score
    like any others; a text over blocks.BLOCK_CHARS is a block of its own; other columns are ignored, and an id column
    named like an output is refused; an empty frame gives no rows.
    """
    names = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "gain"]
    if id_col.lower() in names:
        raise ValueError(f"the id column is named like one of {names}")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.deal("lm", docs, lambda: words, n, in_training)
    joined = blocks.gather(dealt.mapInArrow(frugal("lm", _count), blocks.schema(kind)), n).mapInArrow(frugal("lm", _join_blocks), blocks.schema(kind))
    found = materialize(joined, "lm-blocks")
    lexicon = lexicon_of(found)
    mass = class_mass(found, lexicon)
    model = train(feature_counts(found, lexicon))
    tokens, types = lexicon.tokens, lexicon.types

    def by_class(batches):
        """Of each block: tokens, known ones, base score and class score by document."""
        table = np.concatenate([(model.log_probs(x) / np.log(10)).reshape(-1, CLASSES).astype("float32") for x in np.split(np.arange(BUCKETS), 8)])
        for batch in batches:
            for raw, number, ids in zip(batch.column("body"), batch.column("block").to_pylist(), batch.column("ids").to_pylist()):
                b = Block(raw.as_py(), lexicon)
                base = np.log10((b.counts + 0.5) / (tokens + 0.5 * (types + 1)))[b.word]
                own = table[b.one * BUCKETS + b.two, b.cls[b.word]].astype("f8")
                sums = [b.sizes, b.per_document((b.counts > 0)[b.word].astype("i8")), *(b.per_document(x).view("i8") for x in (base, own))]
                yield blocks.rows([(0, number, blocks.PLACES, 0, np.concatenate(sums).tobytes(), ids)], batch.column("ids").type.value_type)

    def total(batches):
        block, answers = None, []
        for batch in batches:
            for number, what, raw, ids in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("body"), batch.column("ids")):
                if number != block:
                    block, answers = number, []
                raw = raw.as_py()
                if what == blocks.WORDS:
                    answers.append(blocks.unbundle(raw))
                    continue
                sizes, known, base, score = np.frombuffer(raw, "i8").reshape(4, -1)
                base, score = base.view("f8"), score.view("f8").copy()
                for docs, sums in answers:
                    score[blocks.unpack(docs)] += np.frombuffer(zstandard.decompress(sums))
                mine = ids.values
                held = [not in_training(i) for i in mine.to_pylist()]
                yield pa.record_batch([mine, pa.array(held, pa.bool_()), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), tokens)), pa.array(base), pa.array(score), pa.array((score - base) / sizes)], names=["id", *names])

    within = _deal_pairs(found, lexicon, n).mapInArrow(frugal("lm", _fit_dealt(mass)), blocks.schema(kind))
    own = _rows_of(found, blocks.PLACES).mapInArrow(frugal("lm", by_class), blocks.schema(kind))
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, gain double"
    return blocks.gather(within.union(own), n).mapInArrow(frugal("lm", total), schema).withColumnRenamed("id", id_col)
