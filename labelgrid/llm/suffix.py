"""Exact removal of repeated 100-byte strings by blockwise suffix sorting with a sample cover.

Only suffixes that can tie to 100 bytes are sorted.  Content-defined anchors
(see ``anchors``) give each window of 100 bytes one seed; windows of different
seeds differ, so a seed and a distance to it make one suffix bucket.  Blocks
whose seed occurs once need nothing more; equal blocks are settled by 128 bits of
hashes, of the seed and of the whole block, without a look at the bytes; the bytes
of all others are fetched and their suffixes sorted, a few
buckets at a time: by the first V bytes, long ties by precomputed ranks of a
sample of places V apart, then the last V bytes.  Since all members of a bucket
stand at one distance from their anchor, sample places counted from the anchor
form a cover of period V with a single residue, and one rank settles a tie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm import anchors
from labelgrid.llm.anchors import LENGTH
from labelgrid.llm.common import frugal
from labelgrid.plans.materialize import materialize

#: Period of the sample; LENGTH is a multiple.
V = 20
#: Windows sorted at once.
BUCKET = 400_000
#: Blocks that a task gathers before it sends on what it found.
FLUSH = 1_000_000

DOC, TIE, SPANS = "_labelgrid_doc", "_labelgrid_tie", "_labelgrid_spans"
BLOCK, SPAN, WANT = 0, 1, 2
STREAM = "kind int, seed long, body long, doc long, tie long, pos long, upto long"
NAMES = [f.split()[0] for f in STREAM.split(", ")]


def _stream(kind, seed, body, doc, tie, pos, upto) -> pa.RecordBatch:
    n = len(doc)
    full = lambda v: np.full(n, v, "i8") if np.isscalar(v) else v
    cols = [pa.array(np.full(n, kind, "i4")), *[pa.array(np.ascontiguousarray(full(c))) for c in (seed, body, doc, tie, pos, upto)]]
    return pa.record_batch(cols, names=NAMES)


def _split(pos):
    """Anchor, first window's start and number of windows from a packed place."""
    anchor = pos >> 16
    return anchor, anchor - (pos >> 8 & 0xFF), pos & 0xFF


def _find_blocks(batches):
    """Blocks of the texts (BLOCK), and spans that an earlier equal block of the same task covers (SPAN)."""
    held, size = [], 0

    def flush():
        seed, body, doc, tie, pos = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((pos, tie, doc, body, seed))
        seed, body, doc, tie, pos = (c[order] for c in (seed, body, doc, tie, pos))
        again = np.zeros(len(seed), bool)
        again[1:] = (seed[1:] == seed[:-1]) & (body[1:] == body[:-1])
        _, first, windows = _split(pos[again])
        yield _stream(SPAN, doc[again] * 7919 ^ first // 4096, 0, doc[again], tie[again], first, first + windows + LENGTH - 1)
        new = ~again
        yield _stream(BLOCK, seed[new], body[new], doc[new], tie[new], pos[new], 0)

    for batch in batches:
        docs, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
        cut = [(k, *piece) for k, t in enumerate(batch.column("text").to_pylist()) for piece in anchors.pieces((t or "").encode())]
        row, skipped, raw = zip(*cut) if cut else ((), (), ())
        row, skipped = np.array(row, "i8"), np.array(skipped, "i8")
        for a, b in anchors.chunks(raw):
            _, starts, found = anchors.blocks_of(raw[a:b])
            if found is None:
                continue
            place = found.anchor - starts[found.text] + skipped[a:b][found.text]
            text = row[a:b][found.text]
            pos = place << 16 | (found.anchor - found.first) << 8 | found.windows
            held.append((found.seed, found.body, docs[text], ties[text], pos))
            size += len(text)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _settle(batches):
    """Sorted blocks of a seed: repeats of an equal block become spans, first blocks that share a seed are wanted."""
    last = None  # the last first-of-its-kind block, not yet decided
    shared = False  # whether a block with its seed came before it
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        is_block = kind == BLOCK
        if not is_block.all():
            yield batch.filter(pa.array(~is_block))
        if not is_block.any():
            continue
        part = batch.filter(pa.array(is_block))
        seed, body, doc, tie, pos = (part.column(c).to_numpy() for c in ("seed", "body", "doc", "tie", "pos"))
        if last is not None:
            seed, body, doc, tie, pos = (np.concatenate([[x], c]) for x, c in zip(last, (seed, body, doc, tie, pos)))
        same_seed = np.zeros(len(seed), bool)
        same_seed[1:] = seed[1:] == seed[:-1]
        again = same_seed.copy()
        again[1:] &= body[1:] == body[:-1]
        _, first, windows = _split(pos[again])
        yield _stream(SPAN, doc[again], 0, doc[again], tie[again], first, first + windows + LENGTH - 1)
        lead = np.flatnonzero(~again)
        alike = same_seed[lead]
        if last is not None:
            alike[0] = shared
        multi = alike.copy()
        multi[:-1] |= seed[lead[1:]] == seed[lead[:-1]]
        want = lead[:-1][multi[:-1]]
        yield _stream(WANT, seed[want], 0, doc[want], tie[want], pos[want], 0)
        k = lead[-1]
        last, shared = (seed[k], body[k], doc[k], tie[k], pos[k]), bool(alike[-1])
    if last is not None and shared:
        yield _stream(WANT, *[np.array([x]) for x in (last[0], 0, *last[2:])], 0)


def _words(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """V bytes at each place as big-endian numbers, so that they compare like the bytes."""
    wide = lambda k, kind, n: np.ndarray((len(raw) - n + 1,), kind, raw, 0, (1,))[at + k].astype(kind[1:])
    return [wide(0, ">u8", 8), wide(8, ">u8", 8), wide(16, ">u4", 4)]


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense rank of tuples, first key first."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), "i8")
    out[order] = np.cumsum(step)
    return out


def repeated_windows(group: np.ndarray, texts: list[bytes], off: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that repeat an earlier block's, as (block, window number), for blocks in order of their place.

    ``group``: the seed's number; ``off``: the anchor's place in the block.
    """
    # Lay the blocks out with every anchor on a multiple of V, and room to read past the ends.
    sizes = np.array([len(t) for t in texts], "i8")
    lead = -off % V
    room = -(-(lead + sizes + V) // V) * V
    base = np.cumsum(room) - room + lead
    raw = np.zeros(int(room.sum()) + LENGTH + V, "u1")
    flat = np.frombuffer(b"".join(texts), "u1")
    raw[np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    # Ranks of the sample: V bytes, then twice and four times as many by doubling.
    sample = np.arange(0, len(raw) - LENGTH, V)
    r = _rank(*_words(raw, sample))
    for step in (1, 2):
        ahead = np.zeros(len(r), "i8")
        ahead[:-step] = r[step:]
        r = _rank(r, ahead)
    block = np.repeat(np.arange(len(texts)), windows)
    number = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[block] + number
    distance = off[block] - number
    tie = r[-(-at // V)]
    bucket = group[block] << 8 | distance + 128
    keys = [bucket, *_words(raw, at), tie, *_words(raw, at + LENGTH - V)]
    order = np.lexsort(keys[::-1])  # stable: equal suffixes stay in order of their place
    again = np.ones(len(order) - 1, bool)
    for k in keys:
        s = k[order]
        again &= s[1:] == s[:-1]
    hit = np.sort(order[1:][again])
    return block[hit], number[hit]


def _sort_buckets(batches):
    """Spans of suffixes that repeat; input sorted by seed, then place.  Whole seeds are gathered up to BUCKET windows.

    A single seed with more windows than that is taken one distance at a time.
    """
    seeds, docs, ties, places, texts, size = [], [], [], [], [], 0

    def solve(n):
        seed, doc, tie, pos, text = np.array(seeds[:n], "i8"), np.array(docs[:n], "i8"), np.array(ties[:n], "i8"), np.array(places[:n], "i8"), texts[:n]
        group = np.cumsum(np.concatenate([[0], seed[1:] != seed[:-1]]))
        anchor, first, windows = _split(pos)
        off = anchor - first
        if group[-1] or windows.sum() <= BUCKET:
            parts = [(np.arange(n), np.zeros(n, "i8"), windows)]
        else:
            parts = []
            for d in range(int((off - windows).min()) + 1, int(off.max()) + 1):
                w = off - d  # the window at this distance, if the block has it
                mine = np.flatnonzero((w >= 0) & (w < windows))
                if len(mine) > 1:
                    parts.append((mine, w[mine], np.ones(len(mine), "i8")))
        for mine, skip, count in parts:
            block, number = repeated_windows(group[mine], [text[k][s : s + c + LENGTH - 1] for k, s, c in zip(mine.tolist(), skip.tolist(), count.tolist())], off[mine] - skip, count)
            if not len(block):
                continue
            start = first[mine][block] + skip[block] + number
            cut = np.ones(len(block), bool)
            cut[1:] = (block[1:] != block[:-1]) | (start[1:] != start[:-1] + 1)
            a = np.flatnonzero(cut)
            b = np.append(a[1:], len(block)) - 1
            who = mine[block[a]]
            yield _stream(SPAN, 0, 0, doc[who], tie[who], start[a], start[b] + LENGTH)

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("seed", "doc", "tie", "pos", "bytes")))
        for seed, doc, tie, pos, raw in rows:
            if size >= BUCKET and seed != seeds[-1]:
                yield from solve(len(seeds))
                seeds, docs, ties, places, texts, size = [], [], [], [], [], 0
            seeds.append(seed)
            docs.append(doc)
            ties.append(tie)
            places.append(pos)
            texts.append(raw)
            size += pos & 0xFF
    if seeds:
        yield from solve(len(seeds))


def _fetch(batches):
    """The bytes of the wanted blocks."""
    for batch in batches:
        out = [[], [], [], [], []]
        for doc, tie, text, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text", "want"))):
            raw = (text or "").encode()
            for w in want:
                anchor, first, windows = _split(w["pos"])
                for col, v in zip(out, (w["seed"], doc, tie, w["pos"], raw[first : first + windows + LENGTH - 1])):
                    col.append(v)
        yield pa.record_batch([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())], names=["seed", "doc", "tie", "pos", "bytes"])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with DOC and TIE, both long: the place of a row in the order.

    Order is by id, NULL first; only if ids repeat, rows of one id follow in order of their texts' hashes.
    """
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    ids = df.select(doc.alias("doc")).groupBy("doc").count()
    unique = ids.where("count > 1").isEmpty()
    return df.withColumns({DOC: doc, TIE: F.lit(0).cast("long") if unique else F.xxhash64(text_col)})


def remove_repeats(df: DataFrame, on_doc, extra: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default: the id) of each row and the columns ``extra`` that ``on_doc(bytes, spans)`` makes.

    ``spans`` are the maximal runs of bytes to remove, as rows of (start, end): all bytes of a 100-byte string
    that also starts earlier, in a smaller id or before it in the same text, judged on the input.  Ids are whole
    numbers.  A NULL text is empty and stays as it is; rows equal in id and text are one document; texts of any length
    are cut into overlapping pieces; columns not in ``keep`` are ignored; an empty frame gives no rows.
    """
    keep = keep or [id_col]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = keyed(df.select(*dict.fromkeys([*keep, id_col, text_col])), id_col, text_col)
    slim = docs.select(F.col(DOC).alias("doc"), F.col(TIE).alias("tie"), F.col(text_col).alias("text"))
    found = slim.mapInArrow(frugal("suffix", _find_blocks), STREAM).repartition(n, "seed").sortWithinPartitions("kind", "seed", "body", "doc", "tie", "pos")
    found = materialize(found.mapInArrow(frugal("suffix", _settle), STREAM).drop("body"), "blocks")
    want = found.where(F.col("kind") == WANT).groupBy("doc", "tie").agg(F.collect_list(F.struct("seed", "pos")).alias("want"))
    fetched = slim.join(want, ["doc", "tie"]).mapInArrow(frugal("suffix", _fetch), "seed long, doc long, tie long, pos long, bytes binary")
    sorted_ = fetched.repartition(n, "seed").sortWithinPartitions("seed", "doc", "tie", "pos").mapInArrow(frugal("suffix", _sort_buckets), STREAM)
    spans = found.where(F.col("kind") == SPAN).select("doc", "tie", "pos", "upto").unionByName(sorted_.select("doc", "tie", "pos", "upto"))
    spans = spans.groupBy(F.col("doc").alias(DOC), F.col("tie").alias(TIE)).agg(F.collect_list(F.struct("pos", "upto")).alias(SPANS))
    joined = docs.join(spans, [DOC, TIE], "left").select(*keep, *([text_col] if text_col not in keep else []), SPANS)
    text_at, names = joined.columns.index(text_col), [f.split()[0] for f in extra.split(", ")]

    def finish(batches):
        for batch in batches:
            lists = batch.column(SPANS)
            flat = lists.flatten()
            a, b = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            stops = np.cumsum(sizes).tolist()
            out = []
            for t, lo, hi in zip(batch.column(text_at).to_pylist(), [0, *stops], stops):
                out.append(on_doc(t, merged(a[lo:hi], b[lo:hi])))
            cols = list(zip(*out)) or [[] for _ in names]
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.record_batch([*kept, *[pa.array(c) for c in cols]], names=[*keep, *names])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return joined.mapInArrow(frugal("suffix", finish), f"{own}, {extra}")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the runs [a, b), as ascending maximal runs."""
    if not len(a):
        return np.empty((0, 2), "i8")
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return np.column_stack([a[at], b[np.append(at[1:], len(a)) - 1]])


def kept_bytes(text: str | None, spans: np.ndarray) -> bytes:
    raw = (text or "").encode()
    ends = [0, *spans[:, 1].tolist()]
    return b"".join(raw[a:b] for a, b in zip(ends, [*spans[:, 0].tolist(), len(raw)]))


def digest(text: str | None, spans: np.ndarray) -> tuple:
    """``n_bytes, n_removed, n_spans, kept_sha256``."""
    import hashlib

    rest = kept_bytes(text, spans)
    removed = int((spans[:, 1] - spans[:, 0]).sum())
    return len(rest) + removed, removed, len(spans), hashlib.sha256(rest).hexdigest()


DIGEST = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def kept_text(text: str | None, spans: np.ndarray) -> tuple:
    """``text, removed``: what is left, without characters that a cut has split; a NULL stays NULL."""
    rest = None if text is None else kept_bytes(text, spans).decode("utf-8", "ignore")
    return rest, int((spans[:, 1] - spans[:, 0]).sum())


KEPT = "text string, removed bigint"
