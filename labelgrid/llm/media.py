"""TIFF in binary columns: a decoder that gives one row per page, and a writer for test and storage.

Directories are walked with a check against loops; strips and tiles may be
stored raw, as PackBits, LZW or deflate, with or without horizontal prediction.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Tags, field types (code -> struct letter) and compression codes of the format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, PER_PIXEL, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES = 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}
RAW, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, EOI = 256, 257
#: Bytes of samples of a page, or of a tile, at most: what an Arrow column of bytes can hold.
SAMPLES = 2**31 - 2**16
#: Bytes of media or samples in a batch (a larger value alone).
BATCH = 64 << 20


class MediaError(ValueError):
    """The bytes are no TIFF that this decoder reads."""


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    samples: bytes  # rows from the top, channels interleaved, little-endian


# -- compression --------------------------------------------------------------


def unpack_bits(data: bytes, need: int) -> bytes:
    """At least ``need`` bytes if the data hold them, and at most a run more."""
    out, k, n, got = [], 0, len(data), 0
    while k < n and got < need:
        head = data[k]
        if head < 128:
            out.append(data[k + 1 : k + 2 + head])
            k += head + 2
        elif head > 128:
            out.append(data[k + 1 : k + 2] * (257 - head))
            k += 2
        else:
            k += 1
            continue
        got += len(out[-1])
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(part):
        for k in range(0, len(part), 128):
            got = part[k : k + 128]
            out.append(bytes([len(got) - 1]) + got)

    for m in _RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(data[at:])
    return b"".join(out)


def unlzw(data: bytes, need: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early.  Stops once ``need`` bytes are there."""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, last, got = list(base), [], None, 0
    width, buffer, have = 9, 0, 0
    for byte in data:
        buffer, have = (buffer << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = buffer >> have
        buffer &= (1 << have) - 1
        if code == EOI:
            break
        if code == CLEAR:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            if code > 255:
                raise MediaError("LZW starts with no byte")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table) < 4096:
                entry = last + last[:1]
            else:
                raise MediaError("LZW code out of range")
            if len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        last = entry
        got += len(entry)
        if got >= need:
            break
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    out, have, value = [], 0, CLEAR  # bits not yet written, behind a leading clear code
    table, width, free, have = {}, 9, 258, 9
    if not data:
        return _bits(value << 9 | EOI, 18)
    word, known = data[0], table.get
    for b in memoryview(data)[1:]:
        key = word << 8 | b
        code = known(key)
        if code is not None:
            word = code
            continue
        value, have = value << width | word, have + width
        table[key] = free
        free += 1
        if free >> width:
            width += 1
        if free == 4094:
            value, have = value << 12 | CLEAR, have + 12
            table.clear()
            width, free = 9, 258
        if have > 4096:
            rest = have & 7
            out.append((value >> rest).to_bytes(have >> 3, "big"))
            value, have = value & (1 << rest) - 1, rest
        word = b
    value, have = value << width | word, have + width
    if free + 1 > (1 << width) - 1 and width < 12:
        width += 1
    out.append(_bits(value << width | EOI, have + width))
    return b"".join(out)


def _bits(value: int, have: int) -> bytes:
    """``have`` bits, filled up with zeros to whole bytes."""
    return (value << (-have & 7)).to_bytes(-(-have // 8), "big")


def expand(data: bytes, compression: int, need: int) -> bytes:
    """What ``data`` hold, no more than about ``need`` bytes of it whatever they claim."""
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, need)
    if compression == LZW:
        return unlzw(data, need)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need)
    raise MediaError(f"compression {compression}")


def compress(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, PACKBITS: pack_bits, LZW: lzw}.get(compression, lambda d: zlib.compress(d, 1))(data)


# -- reading ------------------------------------------------------------------


def directories(data: bytes):
    """``order, {tag: values}`` of each image directory; a loop or a bad offset is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise MediaError("no TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise MediaError("bad directory offset")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise MediaError("truncated directory")
        tags = {}
        for k in range(n):
            where = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, where)
            if kind not in TYPES:
                continue
            size = struct.calcsize("=" + TYPES[kind]) * count
            start = where + 8 if size <= 4 else struct.unpack_from(order + "I", data, where + 8)[0]
            if start + size > len(data):
                raise MediaError("truncated field")
            tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, start)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def unpredict(block: np.ndarray, predictor: int) -> np.ndarray:
    """Undo horizontal differencing of rows x columns x channels."""
    if predictor == 1:
        return block
    if predictor != 2:
        raise MediaError(f"predictor {predictor}")
    return np.cumsum(block, axis=1, dtype=block.dtype)


def read_pages(data: bytes):
    """Yields every page, in the order of the directories; 8- or 16-bit samples, interleaved channels.

    A page of more than SAMPLES bytes, or fields that don't fit each other, are a MediaError.
    """
    for order, tags in directories(data):
        one = lambda tag, default=0: (tags.get(tag) or (default,))[0]
        width, height, channels = one(WIDTH), one(LENGTH), one(PER_PIXEL, 1)
        bits, how, predictor = tags.get(BITS) or (1,), one(COMPRESSION, RAW), one(PREDICTOR, 1)
        if not width or not height or not channels or len(set(bits)) != 1 or bits[0] not in (8, 16) or one(PLANAR, 1) != 1:
            raise MediaError("unsupported layout")
        kind = np.dtype(order + ("u1" if bits[0] == 8 else "u2"))
        tiled = TILE_AT in tags
        wide, high = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS, height), height))
        if not wide or not high:
            raise MediaError("strips or tiles without a size")
        starts, sizes = (tags.get(TILE_AT), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_AT), tags.get(STRIP_BYTES))
        across, down = -(-width // wide), -(-height // high)
        if not starts or not sizes or len(starts) < across * down or len(sizes) < across * down:
            raise MediaError("missing strips or tiles")
        pixel = channels * kind.itemsize
        if width * height * pixel > SAMPLES or wide * high * pixel > SAMPLES:
            raise MediaError("too large a page")
        rows_of = []  # bands of strips or tiles, so that no page is held before its data were seen to be there
        for y in range(0, height, high):
            band = []
            rows = high if tiled else min(high, height - y)
            for x in range(across):
                k = y // high * across + x
                need = rows * wide * pixel
                raw = expand(data[starts[k] : starts[k] + sizes[k]], how, need)
                if len(raw) < need:
                    raise MediaError("short strip or tile")
                block = np.frombuffer(raw[:need], kind).reshape(rows, wide, channels).astype(kind.newbyteorder("="))
                band.append(unpredict(block, predictor)[: height - y, : width - x * wide])
            rows_of.append(np.concatenate(band, axis=1) if across > 1 else band[0])
        image = np.concatenate(rows_of)
        yield Page(width, height, channels, bits[0], how, image.astype(kind.newbyteorder("<")).tobytes())


# -- writing ------------------------------------------------------------------


def write_pages(pages: list[Page], order: str = "<", predictor: int = 1, tile: int = 0, rows: int = 256) -> bytes:
    """A TIFF of 8- or 16-bit pages, as strips of ``rows`` rows or square tiles (a multiple of 16 wide)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for p in pages:
        kind = np.dtype("<u1" if p.bits == 8 else "<u2")
        image = np.frombuffer(p.samples, kind).reshape(p.height, p.width, p.channels)
        wide, high = (tile, tile) if tile else (p.width, min(rows, p.height))
        starts, sizes = [], []
        for y in range(0, p.height, high):
            for x in range(0, p.width, wide):
                block = image[y : y + high, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                raw = compress(block.astype(kind.newbyteorder(order)).tobytes(), p.compression)
                starts.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        fields = [(WIDTH, 4, [p.width]), (LENGTH, 4, [p.height]), (BITS, 3, [p.bits] * p.channels), (COMPRESSION, 3, [p.compression]), (PHOTOMETRIC, 3, [2 if p.channels == 3 else 1])]
        fields += [] if tile else [(STRIP_AT, 4, starts)]
        fields += [(PER_PIXEL, 3, [p.channels])]
        fields += [] if tile else [(ROWS, 4, [high]), (STRIP_BYTES, 4, sizes)]
        fields += [(PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_AT, 4, starts), (TILE_BYTES, 4, sizes)] if tile else []
        entries = []
        for tag, kind_, values in fields:
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind_]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind_, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- frames -------------------------------------------------------------------


def tiff_pages(df: DataFrame, media_col: str, keep: list[str], on_page=None, extra: str = "") -> DataFrame:
    """One row per page: the ``keep`` columns, then ``page, width, height, channels, bits, compression, error, samples``.

    Unreadable bytes give one row with page NULL and the reason in ``error``; a NULL is unreadable, and
    so are an empty value and one whose pages hold more than SAMPLES bytes.  Repeated rows stay; columns but ``keep`` are ignored, and one of ``keep`` named like an output is refused.  ``on_page(page) -> tuple`` replaces ``samples`` by the columns of ``extra`` (DDL), so that pixels need not
    leave the task; an empty frame gives no rows.
    """
    fields = "page int, width int, height int, channels int, bits int, compression int, error string, "
    names = [f.split()[0] for f in fields.split(", ") if f] + ([f.split()[0] for f in extra.split(", ")] if on_page else ["samples"])
    if {c.lower() for c in keep} & {n.lower() for n in names}:
        raise ValueError(f"a kept column is named like one of {names}")
    own = df.select(*keep, media_col)
    schema = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in keep) + fields + (extra if on_page else "samples binary")
    width = len(names) - 7

    def pages(data):
        """Rows of one value; of a damaged one a single row that gives the reason."""
        rows, size = [], 0
        try:
            if data is None:
                raise MediaError("NULL")
            for n, p in enumerate(read_pages(data)):
                rows.append((n, p.width, p.height, p.channels, p.bits, p.compression, None, *(on_page(p) if on_page else (p.samples,))))
                size += len(p.samples)
                if size > SAMPLES:
                    raise MediaError("too large a file")
            if not rows:
                raise MediaError("no page")
            return rows
        except (MediaError, struct.error, zlib.error, ValueError, MemoryError, OverflowError) as e:
            return [(None,) * 6 + (str(e) or type(e).__name__,) + (None,) * width]

    def decode(batches):
        types = [pa.int32()] * 6 + [pa.string()] + ([] if on_page else [pa.binary()])
        for batch in batches:
            media = batch.column(len(keep))
            from_row, cols, held = [], [[] for _ in names], 0

            def made():
                own_cols = [batch.column(i).take(pa.array(from_row, pa.int64())) for i in range(len(keep))]
                return pa.record_batch([*own_cols, *[pa.array(c, t) for c, t in zip(cols, types)], *[pa.array(c) for c in cols[len(types) :]]], names=[*keep, *names])

            for k in range(batch.num_rows):
                for row in pages(media[k].as_py()):
                    size = sum(len(v) for v in row[7:] if isinstance(v, bytes))
                    if from_row and held + size > BATCH:
                        yield made()
                        from_row, cols, held = [], [[] for _ in names], 0
                    from_row.append(k)
                    held += size
                    for c, v in zip(cols, row):
                        c.append(v)
            if from_row:
                yield made()

    return own.mapInArrow(decode, schema)


UNIT = 192


def _stored(payload: bytes) -> bytes:
    """Rows of 64 pixels of 3 samples; the payload's checksum picks the way of storing, equal for equal texts."""
    page = Page(64, len(payload) // UNIT, 3, 8, DEFLATE, payload)
    way = zlib.crc32(payload) & 3
    if way == 0:
        page.compression = PACKBITS
        return write_pages([page])
    if way == 1:
        page.compression = LZW
        return write_pages([page], order=">")
    if way == 2:
        return write_pages([page], tile=64)
    return write_pages([page], predictor=2)


def texts_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text (NULL: empty) as a TIFF: UTF-8 and blanks up to a positive multiple of 192 bytes.

    ``id, n_bytes, payload_bytes, media_bytes, media_sha256, media``; other columns are ignored, rows repeat as given.
    """
    from pyspark.sql import functions as F

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()

    def store(batches):
        import hashlib

        def made(ids, rows):
            sizes, padded, stored, sha, media = (list(c) for c in zip(*rows))
            return pa.record_batch([ids, *[pa.array(c, pa.int64()) for c in (sizes, padded, stored)], pa.array(sha, pa.string()), pa.array(media, pa.binary())], names=["id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256", "media"])

        for batch in batches:
            first, rows, held = 0, [], 0
            for k, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                payload = raw + b" " * (-len(raw) % UNIT if raw else UNIT)
                media = _stored(payload)
                if rows and held + len(media) > BATCH:
                    yield made(batch.column("id").slice(first, k - first), rows)
                    first, rows, held = k, [], 0
                rows.append((len(raw), len(payload), len(media), hashlib.sha256(media).hexdigest(), media))
                held += len(media)
            if rows:
                yield made(batch.column("id").slice(first), rows)

    return docs.mapInArrow(store, f"id {kind}, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, media binary").withColumnRenamed("id", id_col)


def page_digest(page: Page) -> tuple:
    """``payload_sha256, tail_crc32, feature`` of a page's samples as read back."""
    import hashlib

    data = page.samples
    flat = np.frombuffer(data, "u1")
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    feature = f"mean={flat.mean():.4f};std={flat.std():.4f};entropy={entropy:.4f};pages={page.width}x{page.height}x{page.channels}"
    return hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), feature


DIGEST = "payload_sha256 string, tail_crc32 bigint, feature string"
