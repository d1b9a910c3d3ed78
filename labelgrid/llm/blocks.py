"""Distinct words of blocks of documents, dealt out by word and joined back.

A block is a run of documents of one task.  Its tokens become positions: per
document the code of the token at each place, where a code names a distinct
word of the block (0: the next word that occurs once).  Words go to buckets by
their hash, so that all blocks' copies of a word meet in one task, each block
sending it once; whatever that task works out per word returns to the block,
and the positions put it in order.  Positions travel packed, not as a row per
token.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm.common import frugal

#: Code points of a block's texts, at most (a longer text is a block of its own).
BLOCK_CHARS = 16_000_000

WORDS, PLACES = 0, 1  # kinds of rows; a block's words sort before its places


class Numbered(dict):
    """Numbers keys from 0 as they are first asked for."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, "<u4").view("u1").reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    return bundle(pack(np.array([len(w) for w in words], "u4")), zstandard.ZstdCompressor(level=3).compress(b"".join(words)))


def unpack_words(raw: bytes) -> list[bytes]:
    sizes, flat = unbundle(raw)
    flat = zstandard.ZstdDecompressor().decompress(flat)
    stops = np.cumsum(unpack(sizes).astype("i8")).tolist()
    return [flat[a:b] for a, b in zip([0, *stops], stops)]


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(raw: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 4 * n, []
    for size in struct.unpack_from(f"<{n}I", raw, 4):
        out.append(raw[at : at + size])
        at += size
    return out


def schema(kind: str) -> str:
    return f"key int, block long, kind int, bucket int, body binary, ids array<{kind}>"


def rows(fields: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    key, block, what, bucket, body, ids = zip(*fields)
    return pa.record_batch(
        [pa.array(key, pa.int32()), pa.array(block, pa.int64()), pa.array(what, pa.int32()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), pa.array(ids, pa.list_(kind))],
        names=["key", "block", "kind", "bucket", "body", "ids"])


def recoded(places: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all places, each word's code, and the counts: words from 1 by falling count, then those that occur once."""
    flat = np.concatenate(places) if places else np.empty(0, "u4")
    counts = np.bincount(flat, minlength=n_words)
    code = np.empty(n_words, "u4")
    code[np.argsort(-counts, kind="stable")] = np.arange(1, n_words + 1)
    return np.where(counts == 1, np.uint32(0), code)[flat], code, counts


def resolve(codes: np.ndarray, n_words: int) -> np.ndarray:
    """Undo the zeros: they stand for the last codes, in order."""
    once = codes == 0
    out = codes.astype("i8")
    out[once] = np.arange(n_words - int(once.sum()) + 1, n_words + 1)
    return out - 1


def parts(sizes: np.ndarray, codes: np.ndarray, n_words: int, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """A block's documents a to b, up to ``limit`` tokens or one document, and the numbers of their words (as ``resolve``)."""
    stops, a, at = np.cumsum(sizes), 0, 0
    once = n_words - int(np.count_nonzero(codes == 0))  # the number of the next word that occurs once
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(stops, at + limit, "right")))
        out = codes[at : stops[b - 1]].astype("i8") - 1
        zeros = np.flatnonzero(out < 0)
        out[zeros] = np.arange(once, once + len(zeros))
        yield a, b, out
        once += len(zeros)
        a, at = b, int(stops[b - 1])


def deal(operator: str, docs: DataFrame, tokens: Callable[[], Callable[[str], list]], n: int, weigh=None) -> DataFrame:
    """``docs`` (id, text) as rows of words by bucket and rows of places by block, dealt to ``n`` partitions.

    ``tokens()`` makes the function from a text to its tokens (bytes or str) in the worker.  ``weigh(id)`` marks
    documents whose words count; each word then carries its count in those.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        split, part, number = tokens(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for a, b in _runs(texts):
                local, places = Numbered(), []
                for t in texts.slice(a, b - a).to_pylist():
                    places.append(np.array(list(map(local.__getitem__, split(t or ""))), "u4"))
                mine = ids.slice(a, b - a).to_pylist()
                codes, code, _ = recoded(places, len(local))
                sizes = np.array([len(p) for p in places], "u4")
                block = part << 32 | number
                number += 1
                out = [(block * 2654435761 >> 7 & 0x7FFFFFFF, block, PLACES, 0, bundle(pack(sizes), pack(codes), struct.pack("<I", len(local))), mine)]
                names = [w if isinstance(w, bytes) else w.encode() for w in local]
                counted = None
                if weigh:
                    used = np.repeat(np.array([weigh(i) for i in mine], bool), sizes)
                    counted = np.bincount(np.concatenate(places)[used] if len(places) else [], minlength=len(local))
                bucket = np.array([zlib.crc32(w) for w in names], "i8") % n
                order = np.lexsort((code, bucket))
                stops = np.flatnonzero(np.diff(bucket[order])) + 1
                for at in np.split(order, stops) if len(order) else []:
                    parts = [pack(code[at]), pack_words([names[k] for k in at])]
                    out.append((int(bucket[at[0]]), block, WORDS, int(bucket[at[0]]), bundle(*parts, *([pack(counted[at])] if weigh else [])), None))
                del places, local, names
                for k in range(0, len(out), 64):
                    yield rows(out[k : k + 64], ids.type)

    return docs.select("id", "text").mapInArrow(frugal(operator, run), schema(kind)).repartitionById(n, F.col("key") % n)  # a bucket a partition, none shared


def _runs(texts) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype("i8"))
    a, n = 0, len(sizes)
    while a < n:
        base = sizes[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(sizes, base + BLOCK_CHARS, "right")))
        yield a, b
        a = b


def gather(answered: DataFrame, n: int) -> DataFrame:
    """Answers and places of a block together, the answers first."""
    return answered.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")


def per_block(batches, done: Callable) -> Iterator:
    """Calls ``done(ids column, sizes, codes, n_words, answers)`` for each block; ``answers`` are unbundled bodies."""
    block, answers = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            at = batch.column("block")[k].as_py()
            if at != block:
                block, answers = at, []
            body = unbundle(batch.column("body")[k].as_py())
            if batch.column("kind")[k].as_py() == WORDS:
                answers.append(body)
                continue
            n_words = struct.unpack("<I", body[2])[0]
            ids = batch.column("ids").slice(k, 1).flatten()
            yield from done(ids, unpack(body[0]).astype("i8"), unpack(body[1]), n_words, answers)
