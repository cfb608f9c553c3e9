"""Media columns: bytes as baseline JPEG, read back as DC-only luminance thumbnails.

encode_jpegs stores a payload losslessly in the unit of the format, the quantised coefficient: every byte is the DC coefficient of
one 8 x 8 block of a grey image 192 blocks wide, with a quantiser of 8, so that a viewer shows it as a flat square of that
brightness, and the image at an eighth of its size is the payload. The scan has a restart marker after every 64 blocks.

decode_thumbnails parses markers and tables and Huffman-decodes scans to the luminance plane at an eighth of the size. For images of
one component whose AC table knows nothing but end-of-block, all restart intervals of a batch are decoded at once, a block of each in
every step; any other baseline image (several components, sampling factors, AC coefficients) goes through a plain decoder.

A payload of more than 8191 rows becomes several images one after the other. Null and empty texts give one row of blanks. Rows that
repeat are returned as often as they come, with equal values; a null id is returned as it is. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

WIDE, INTERVAL, MOST_ROWS = 192, 64, 8191

# The zigzag-free quantiser (8 for DC, 1 elsewhere), and code lengths of the DC categories 0 to 8 chosen for text.
QUANTISERS = bytes([8] + [1] * 63)
CODE_LENGTHS = {5: 2, 4: 2, 7: 2, 3: 4, 2: 4, 6: 5, 1: 6, 0: 6, 8: 7}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table's bytes in DHT (16 counts, then symbols), and (code, length) of each symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(lengths[s] == n for s in symbols) for n in range(1, 17)) + bytes(symbols), codes


DC_TABLE, DC_CODES = _canonical(CODE_LENGTHS)
AC_TABLE, _ = _canonical({0: 1})


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 on: the bits of its block (category, value, end of block) and their number."""
    bits, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = DC_CODES[category]
        value = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255] = ((code << category) | value) << 1
        sizes[d + 255] = length + category + 1
    return bits, sizes


_BITS, _SIZES = _symbols()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, n_bytes: int) -> bytes:
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, b"bytes=%d" % n_bytes) + _segment(0xDB, b"\0" + QUANTISERS)
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * WIDE, 1) + b"\1\x11\0") + _segment(0xC4, b"\0" + DC_TABLE) + _segment(0xC4, b"\x10" + AC_TABLE)
        + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def pad(text: bytes) -> bytes:
    """The payload of a text: blanks up to a positive multiple of the width."""
    return text.ljust(max(WIDE, -(-len(text) // WIDE) * WIDE))


def encode_jpegs(texts: list[bytes]) -> list[bytes]:
    """The stored form of each text."""
    if not texts:
        return []
    payloads = [pad(t) for t in texts]
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16).reshape(-1, INTERVAL) - 128
    diffs = np.diff(samples, axis=1, prepend=np.int16(0)) + 255
    bits, sizes = _BITS[diffs], _SIZES[diffs]
    # two blocks to a word of at most 32 bits and at least 14, so that no two words of an interval begin in the same byte
    words = (bits[:, ::2] << sizes[:, 1::2].astype(np.uint64)) | bits[:, 1::2]
    lengths = sizes[:, ::2] + sizes[:, 1::2]
    ends = np.cumsum(lengths, axis=1)
    total = ends[:, -1]
    n_bytes = (total + 7) // 8
    first = np.cumsum(n_bytes) - n_bytes
    at = (ends - lengths + 8 * first[:, None]).ravel()
    word = words.ravel() << (40 - lengths.ravel() - (at & 7)).astype(np.uint64)
    at >>= 3
    data = np.zeros(int(n_bytes.sum()) + 8, np.uint8)
    for k in range(5):
        data[at + k] |= ((word >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    data = data[:-8]
    data[first + n_bytes - 1] |= ((1 << (8 * n_bytes - total)) - 1).astype(np.uint8)
    # a zero after each 255, and a marker after each interval
    high = data == 255
    interval = np.repeat(np.arange(len(n_bytes)), n_bytes)
    stuffed = np.cumsum(high) - high
    place = np.arange(len(data)) + stuffed + 2 * interval
    out = np.zeros(len(data) + int(high.sum()) + 2 * len(n_bytes), np.uint8)
    out[place] = data
    interval_ends = np.append(place[first[1:] - 1] + high[first[1:] - 1], place[-1] + high[-1]) + 1
    images = []
    for text, payload in zip(texts, payloads, strict=True):
        left = len(payload) // WIDE
        while left:
            images.append((min(left, MOST_ROWS), len(text), left <= MOST_ROWS))
            left -= images[-1][0]
    rows = np.array([i[0] for i in images])
    counts = rows * (WIDE // INTERVAL)
    within = np.arange(len(n_bytes)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[interval_ends] = 255
    out[interval_ends + 1] = 0xD0 + within % 8
    lasts = np.cumsum(counts) - 1
    out[interval_ends[lasts] + 1] = 0xD9
    scan, stops = out.tobytes(), (interval_ends[lasts] + 2).tolist()
    media, parts, start = [], [], 0
    for (n, size, last), stop in zip(images, stops, strict=True):
        parts.append(_header(n, size) + scan[start:stop])
        start = stop
        if last:
            media.append(b"".join(parts))
            parts = []
    return media


@dataclass
class Image:
    """A parsed image: size in pixels, components (id, h, v, quantiser table), tables, restart interval, and its scan's bytes."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]
    scan_tables: dict[int, tuple[int, int]]
    quantisers: dict[int, int]
    huffman: dict[int, bytes]
    restart: int
    comment: bytes
    scan: bytes

    @property
    def flat(self) -> bool:
        """One component whose blocks are DC alone and take 16 bits at most, with restarts."""
        if len(self.components) != 1 or not self.restart:
            return False
        dc, ac = self.scan_tables[self.components[0][0]]
        return self.huffman[0x10 | ac] == AC_TABLE and all(length + category < 16 for (length, _), category in _codes(self.huffman[dc]).items())


def parse(media: bytes) -> list[Image]:
    """The images of a stored form. Raises ValueError where it isn't baseline JPEG in one scan."""
    images, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        at += 2
        width = height = restart = 0
        components, scan_tables, quantisers, huffman, comment = [], {}, {}, {}, b""
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("no marker where one is due")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker in (0xC0, 0xC1):
                height, width, n = struct.unpack(">HHB", body[1:6])
                components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    huffman[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                comment = body
            elif marker == 0xDA:
                scan_tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                if set(scan_tables) != {c[0] for c in components}:
                    raise ValueError("an image of several scans")
                if any(table not in huffman for dc, ac in scan_tables.values() for table in (dc, 0x10 | ac)):
                    raise ValueError("a Huffman table is missing")
                break
        stop = media.find(b"\xff\xd9", at)
        if stop < 0:
            raise ValueError("the scan does not end")
        images.append(Image(width, height, components, scan_tables, quantisers, huffman, restart, comment, media[at:stop]))
        at = stop + 2
    return images


@functools.lru_cache(64)
def _codes(table: bytes) -> dict[tuple[int, int], int]:
    """Symbol by (length, code)."""
    codes, code, k = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            codes[length, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


@functools.lru_cache(64)
def _flat_lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: the DC difference times 256, plus the bits that the whole flat block takes (0: no such code)."""
    out = np.zeros(1 << 16, np.int32)
    for (length, code), category in _codes(table).items():
        used = length + category + 1
        for value in range(1 << category):
            diff = value if category == 0 or value >> (category - 1) else value - (1 << category) + 1
            low = ((code << category | value) << 1) << (16 - used)
            out[low : low + (1 << (16 - used))] = diff * 256 + used
    return out


def _decode_flat(images: list[Image]) -> list[np.ndarray]:
    """The DC coefficients of flat images, in order of their blocks, all with the same DC table and restart interval."""
    data = np.frombuffer(b"\xff\xd9".join(i.scan for i in images) + b"\xff\xd9", np.uint8)
    high = np.flatnonzero(data[:-1] == 255)
    follows = data[high + 1]
    keep = np.ones(len(data), bool)
    keep[high[follows == 0] + 1] = False
    marks = high[follows >= 0xD0]
    keep[marks] = keep[marks + 1] = False
    kept_before = np.cumsum(keep) - keep
    starts = np.concatenate([[0], kept_before[marks[:-1] + 1] if len(marks) > 1 else np.zeros(0, np.int64)]).astype(np.int64)
    dense = np.concatenate([data[keep], np.full(4, 255, np.uint8)]).astype(np.uint32)
    window = (dense[:-2] << 16) | (dense[1:-1] << 8) | dense[2:]
    blocks = np.array([-(-i.width // 8) * -(-i.height // 8) for i in images])
    step = images[0].restart
    counts = -(-blocks // step)
    if counts.sum() != len(starts):
        raise ValueError("restart markers do not match the image")
    image = images[0]
    lookup = _flat_lookup(image.huffman[image.scan_tables[image.components[0][0]][0]])
    at = 8 * starts
    diffs = np.zeros((step, len(starts)), np.int32)
    most = len(window) - 1
    due = np.concatenate([np.minimum(step, b - step * np.arange(n)) for n, b in zip(counts.tolist(), blocks.tolist(), strict=True)])
    for k in range(step):
        found = lookup[(window[np.minimum(at >> 3, most)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF]
        used = found & 255
        if ((used == 0) & (k < due)).any():
            raise ValueError("no such Huffman code")
        diffs[k] = found >> 8
        at += used
    values = np.cumsum(diffs, axis=0).T
    out, row = [], 0
    for n, b in zip(counts.tolist(), blocks.tolist(), strict=True):
        out.append(values[row : row + n].reshape(-1)[:b])
        row += n
    return out


def _decode_plain(image: Image) -> np.ndarray:
    """The DC coefficients of the first component of any baseline image, in rows and columns of its blocks."""
    h_most, v_most = max(c[1] for c in image.components), max(c[2] for c in image.components)
    single = len(image.components) == 1
    _, h, v, _ = image.components[0]
    wide, tall = -(-image.width // 8), -(-image.height // 8)
    if single:
        mcu_wide, mcu_tall, h, v = wide, tall, 1, 1
    else:
        mcu_wide, mcu_tall = -(-image.width // (8 * h_most)), -(-image.height // (8 * v_most))
    out = np.zeros((mcu_tall * v, mcu_wide * h), np.int32)
    scan, at, bits, held = image.scan, 0, 0, 0

    def need(n: int) -> int:
        nonlocal at, bits, held
        while held < n:
            byte = scan[at] if at < len(scan) else 255
            at += 2 if byte == 255 and at + 1 < len(scan) and scan[at + 1] == 0 else 1
            bits, held = (bits << 8 | byte) & 0xFFFFFFFF, held + 8
        held -= n
        return bits >> held & ((1 << n) - 1)

    def symbol(codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | need(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def value(category: int) -> int:
        raw = need(category) if category else 0
        return raw if category == 0 or raw >> (category - 1) else raw - (1 << category) + 1

    before = dict.fromkeys((c[0] for c in image.components), 0)
    for mcu in range(mcu_wide * mcu_tall):
        if image.restart and mcu and mcu % image.restart == 0:
            at, held = scan.index(b"\xff", at) + 2, 0
            before = dict.fromkeys(before, 0)
        for k, (name, ch, cv, _) in enumerate(image.components):
            dc, ac = image.scan_tables[name]
            for block in range(1 if single else ch * cv):
                before[name] += value(symbol(_codes(image.huffman[dc])))
                if k == 0:
                    out[mcu // mcu_wide * v + block // h, mcu % mcu_wide * h + block % h] = before[name]
                seen = 1
                while seen < 64:
                    s = symbol(_codes(image.huffman[0x10 | ac]))
                    if s == 0:
                        break
                    seen += (s >> 4) + 1
                    value(s & 15)
    return out[:tall, :wide]


def decode_thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each stored form the luminance planes of its images at an eighth of the size, as 8-bit samples."""
    images = [parse(m) for m in media]
    groups: dict[tuple, list[Image]] = {}
    for i in (i for found in images for i in found if i.flat):
        groups.setdefault((i.huffman[i.scan_tables[i.components[0][0]][0]], i.restart), []).append(i)
    planes = {id(i): p for found in groups.values() for i, p in zip(found, _decode_flat(found), strict=True)}

    def plane(i: Image) -> np.ndarray:
        dc = planes[id(i)].reshape(-(-i.height // 8), -(-i.width // 8)) if i.flat else _decode_plain(i)
        q = i.quantisers[i.components[0][3]]
        return np.clip((dc * q + 4) // 8 + 128, 0, 255).astype(np.uint8)

    return [[plane(i) for i in found] for found in images]


def thumbnail_hash(planes: list[np.ndarray]) -> str:
    """Dimensions in pixels of each image, and 64 bits that tell whether each of 8 x 8 fields is darker than its right neighbour."""
    parts = []
    for plane in planes:
        tall, wide = plane.shape
        columns = np.add.reduceat(plane.astype(np.int64), np.arange(9) * wide // 9, axis=1) if wide >= 9 else np.repeat(plane.astype(np.int64), 9, axis=1)[:, :9]
        fields = np.add.reduceat(columns, np.arange(8) * tall // 8, axis=0)
        parts.append(f"{8 * wide}x{8 * tall}:{np.packbits(fields[:, :-1] < fields[:, 1:]).tobytes().hex()}")
    return ";".join(parts)


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(texts: list[bytes]) -> list[tuple]:
    """The values of FIELDS for each text, from its stored form read back."""
    media = encode_jpegs(texts)
    out = []
    for text, stored, planes in zip(texts, media, decode_thumbnails(media), strict=True):
        payload = b"".join(p.tobytes() for p in planes)
        out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), thumbnail_hash(planes)))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in FIELDS.split(", ")]
    for batch in slices(batches, 256):
        rows = describe(texts_of(batch))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encode_jpegs(texts_of(batch)), pa.binary())], ["doc_id", "media"])


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): the stored form of every text, for a table of images."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_stored, f"doc_id {kind}, media binary")


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, *FIELDS) of every row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_rows, f"doc_id {kind}, {FIELDS}")
