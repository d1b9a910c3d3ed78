"""Byte-level BPE over the corpus: every distinct pre-token is encoded once per word bucket, wherever it occurs.

Encoding: pre-tokens and their positions per block, distinct words to buckets,
ids back to the blocks, texts reassembled by position.  Decoding: ids join the
token-byte table, which is broadcast (its size is the vocabulary's), and the
bytes are gathered by id, a block at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.llm import blocks
from labelgrid.llm.common import frugal, per_worker

# Unicode white space, and the letters, numbers and white space up to U+017F.
SPACE = "\t-\r \x85\xa0  -     　"
NEAR = {"\\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ſ", "\\p{N}": "0-9²³¹¼-¾", "\\s": "\t-\r \x85\xa0"}
FAR = re.compile("[^\x00-ſ]")


def splitter(pattern: str):
    """Function from a text to the pattern's matches.

    Texts up to U+017F, nearly all, use ``re`` with the classes spelled out; the others use ``regex``.
    White space is Unicode's in both, without the separators U+001C to U+001F.
    """
    import regex

    far = regex.compile(_spelled(pattern, {"\\s": SPACE}))
    near = re.compile(_spelled(pattern, NEAR))
    return lambda t: (far if FAR.search(t) else near).findall(t)


def _spelled(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with ``\\s`` and the like replaced, inside and outside of brackets; ``\\S`` is the complement."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        for name, members in classes.items():
            if pattern.startswith(name, k):
                out.append(members if inside else f"[{members}]")
                k += len(name)
                break
        else:
            if pattern.startswith("\\S", k) and not inside:
                out.append(f"[^{classes['\\s']}]")
                k += 2
                continue
            c = pattern[k]
            if c == "\\":
                out.append(pattern[k : k + 2])
                k += 2
                continue
            inside = c == "[" or inside and c != "]"
            out.append(c)
            k += 1
    return "".join(out)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


#: Words that a bucket remembers; more are encoded again.
KNOWN = 500_000
#: Words of a block that are put together at once; a document of more is a part of its own.
PART = 500_000


def encoded(df: DataFrame, path: str, pattern: str, on_doc, extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the columns ``extra`` that ``on_doc(ids, decoded)`` makes of each document's ids and the bytes they stand for.

    ``ids``: unsigned 32-bit numbers.  NULL and empty texts have no ids; repeated rows and NULL document ids are kept as
    they are; a text over blocks.BLOCK_CHARS is a block of its own; other columns are ignored, and an id column named
    like one of ``extra`` is refused; an empty frame gives no rows.
    """
    names = [f.split()[0] for f in extra.split(", ")]
    if id_col.lower() in names:
        raise ValueError(f"the id column is named like one of {names}")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.deal("bpe", docs, lambda: per_worker(f"bpe split {pattern}", lambda: splitter(pattern)), n)

    def encode(batches):
        enc = per_worker(f"bpe {path} {pattern}", lambda: _encoder(path, pattern))
        one, known = enc._core_bpe.encode_single_piece, {}  # a pre-token is one piece: the pattern isn't run again
        for batch in batches:
            cols = [batch.column(k) for k in range(batch.num_columns)]
            body = []
            for what, raw in zip(cols[2].to_pylist(), cols[4]):
                raw = raw.as_py()
                if what == blocks.WORDS:
                    codes, words = blocks.unbundle(raw)
                    words = blocks.unpack_words(words)
                    if len(known) > KNOWN:
                        known = {}
                    got = []
                    for w in words:
                        ids = known.get(w)
                        if ids is None:
                            ids = known[w] = one(w)
                        got.append(ids)
                    sizes = np.array([len(g) for g in got], "u4")
                    raw = blocks.bundle(codes, blocks.pack(sizes), blocks.pack(np.array([i for g in got for i in g], "u4")))
                body.append(raw)
            cols[4] = pa.array(body, pa.binary())
            yield pa.record_batch(cols, names=batch.schema.names)

    gathered = blocks.gather(dealt.mapInArrow(frugal("bpe", encode), blocks.schema(kind)), n)

    def assemble(batches):
        """Rows of documents that follow each other in a block: their ids, how many tokens each has, and all their ids."""

        def done(ids, sizes, codes, n_words, answers):
            size, flat, start, at = np.zeros(n_words, "u4"), [], np.zeros(n_words, "i8"), 0
            for c, s, f in answers:
                c, s, f = blocks.unpack(c) - 1, blocks.unpack(s), blocks.unpack(f)
                size[c], start[c] = s, at + np.cumsum(s, dtype="i8") - s
                at += len(f)
                flat.append(f)
            flat = np.concatenate(flat) if flat else np.empty(0, "u4")
            for a, b, words in blocks.parts(sizes, codes, n_words, PART):
                s = size[words].astype("i8")
                pick = np.repeat(start[words] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
                stops = np.concatenate([[0], np.cumsum(s)])[np.cumsum(sizes[a:b])]
                row = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a))
                yield pa.record_batch([row, pa.array([stops.tobytes()], pa.binary()), pa.array([flat[pick].astype("<u4").tobytes()], pa.binary())], names=["ids", "stops", "tokens"])

        yield from blocks.per_block(batches, done)

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                stops = np.frombuffer(batch.column("stops")[k].as_py(), "i8").tolist()
                tokens = np.frombuffer(batch.column("tokens")[k].as_py(), "<u4")
                table = batch.column(TABLE)[k].values.cast(pa.large_binary())
                text = table.take(pa.array(tokens))
                at, raw = np.frombuffer(text.buffers()[1], "i8") if len(text) else [0], text.buffers()[2]
                out = [on_doc(tokens[a:b], raw[int(at[a]) : int(at[b])].to_pybytes() if b > a else b"") for a, b in zip([0, *stops], stops)]
                cols = list(zip(*out)) or [[] for _ in names]
                yield pa.record_batch([batch.column("ids").slice(k, 1).flatten(), *[pa.array(c) for c in cols]], names=["id", *names])

    whole = gathered.mapInArrow(frugal("bpe", assemble), f"ids array<{kind}>, stops binary, tokens binary")
    joined = whole.crossJoin(F.broadcast(token_bytes(df.sparkSession, path)))  # one row, of the vocabulary's size
    return joined.mapInArrow(frugal("bpe", finish), f"id {kind}, {extra}").withColumnRenamed("id", id_col)


#: Name of the column with the bytes of all tokens.
TABLE = "_labelgrid_token_bytes"


def token_bytes(spark, path: str) -> DataFrame:
    """The token-byte table as one row: the bytes of each id, in order; NULL for an id that is not used."""
    known = {v: k for k, v in ranks(path).items()}
    return spark.createDataFrame([([bytearray(known[i]) if i in known else None for i in range(max(known) + 1)],)], f"{TABLE} array<binary>")


def digest(ids: np.ndarray, text: bytes) -> tuple:
    """``n_tokens, ids_sha256, decoded_sha256``: the last of the bytes that the ids stand for."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def decoded(df: DataFrame, path: str, ids_col: str, out_col: str = "text") -> DataFrame:
    """``df`` and the bytes of an array of ids (a column of that name is replaced), by a join with the token-byte table.

    NULL ids give NULL; an empty array gives empty bytes; an id outside of the vocabulary is an error.  Bytes are put
    together as one string of hex digits, in time linear in the tokens.
    """
    joined = df.crossJoin(F.broadcast(token_bytes(df.sparkSession, path)))  # one row, of the vocabulary's size
    hexed = F.transform(ids_col, lambda i: F.coalesce(F.hex(F.element_at(TABLE, i + 1)), F.raise_error(F.lit("no such id"))))
    return joined.withColumn(out_col, F.unhex(F.array_join(hexed, ""))).drop(TABLE)
