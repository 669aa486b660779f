"""Media columns: baseline JPEG written and read in numpy.

A payload is stored in the quantised coefficients of a grey baseline JPEG, 64 bytes a
block, each byte as the coefficient byte + 256, so nothing is lost. Reading parses the
markers, decodes the Huffman-coded scan, all restart intervals of a batch in step, and
keeps the luminance DC values as a thumbnail, which is hashed.

Defined cases: null text has the payload of the empty text, 64 zero bytes; equal texts
give equal media; repeated rows stay; an empty table gives no rows; columns named as
the added ones are replaced. A stream that is not baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlens.llm.arrow import chunks, flat_bytes, with_columns
from formlens.llm.common import documents

BLOCK = 64
SHIFT = 256
CHUNK = 2 << 20
#: Blocks in a column of the picture; JPEG sides end at 65535 pixels.
TALLEST = 8191


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: One category each, of nine bits, with the one-bit code 0.
DC_TABLE = segment(0xC4, bytes([0x00, 1, *[0] * 15, 0x09]))
AC_TABLE = segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x09]))
QUANT = segment(0xDB, bytes([0, *[1] * 64]))


def header(blocks: int) -> tuple[bytes, int]:
    """The segments before the scan of a picture with so many payload blocks, and the blocks it has in all."""
    wide = -(-blocks // TALLEST)
    tall = -(-blocks // wide)
    frame = segment(0xC0, bytes([8]) + (8 * tall).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    note = segment(0xFE, b"payload-blocks=%d" % blocks)
    return b"\xff\xd8" + note + QUANT + frame + DC_TABLE + AC_TABLE + segment(0xDD, b"\x00\x01") + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])), wide * tall


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value followed by zeros up to a positive multiple of BLOCK, as rows of blocks, and the rows' offsets."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    starts = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(starts[-1] * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts[:-1] * BLOCK - offsets[:-1], sizes)] = data
    return out.reshape(-1, BLOCK), starts


def coded(blocks: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of each block, 80 of them, followed by room for a restart marker."""
    v = blocks.reshape(-1, BLOCK // 4, 4).astype(np.uint16) + SHIFT
    a, b, c, d = v[..., 0], v[..., 1], v[..., 2], v[..., 3]
    five = np.stack([a >> 2, (a & 3) << 6 | b >> 4, (b & 15) << 4 | c >> 6, (c & 63) << 2 | d >> 8, d & 255], axis=-1).astype(np.uint8)
    out = np.empty((len(blocks), 82), np.uint8)
    out[:, :80] = five.reshape(-1, 80)
    out[:, 80] = 0xFF
    return out


def jpegs(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A JPEG stream for each value."""
    blocks, starts = padded(data, offsets)
    scan = coded(blocks)
    stuffed = (scan[:, :80] == 0xFF).any(axis=1)
    zero = coded(np.zeros((1, BLOCK), np.uint8))[0, :80].tobytes()
    out = []
    for i in range(len(offsets) - 1):
        a, b = starts[i], starts[i + 1]
        head, total = header(int(b - a))
        scan[a:b, 81] = 0xD0 + np.arange(b - a) % 8
        if stuffed[a:b].any():
            body = b"".join(x[:80].tobytes().replace(b"\xff", b"\xff\x00") + x[80:].tobytes() for x in scan[a:b])
        else:
            body = scan[a:b].tobytes()
        for k in range(int(b - a), total):  # blocks that fill the picture's last column
            body += zero + bytes([0xFF, 0xD0 + k % 8])
        out.append(head + body[:-2] + b"\xff\xd9")
    return out


class Picture:
    """What the markers of a stream say: sizes, tables, components, and where its scan is."""

    def __init__(self, stream: bytes) -> None:
        if stream[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        self.tables: dict[int, bytes] = {}
        self.steps: dict[int, int] = {}  # of each quantisation table, that of DC values
        self.interval, self.held, at = 0, None, 2  # held: the blocks of a payload, where a note of this module tells them
        while True:
            if at + 4 > len(stream) or stream[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
            body = stream[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.components = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])}
                self.step_of = {body[6 + 3 * i]: body[8 + 3 * i] for i in range(body[5])}
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.steps[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    self.tables[body[k]] = body[k + 1 : k + 17 + n]
                    k += 17 + n
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xFE:
                told = re.fullmatch(rb"payload-blocks=(\d{1,9})", body)
                self.held = int(told[1]) if told else self.held
            elif marker == 0xDA:
                self.use = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline frame")
        end = len(stream) - 2 if stream[-2:] == b"\xff\xd9" else len(stream)
        self.scan = np.frombuffer(stream, np.uint8, end - at, at)
        if len(self.components) == 1:
            self.components = dict.fromkeys(self.components, (1, 1))
        self.across = -(-self.width // (8 * max(h for h, _ in self.components.values())))
        self.down = -(-self.height // (8 * max(v for _, v in self.components.values())))
        self.layout = tuple((c, self.tables[self.use[c][0]], self.tables[self.use[c][1]]) for c, (h, v) in self.components.items() for _ in range(h * v))


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length * 256 + table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def bits(ahead: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n bits from each bit position, n up to 16."""
    return (ahead[at >> 3] >> (32 - (at & 7) - n)) & ((1 << n) - 1)


def decode_block(ahead: np.ndarray, at: np.ndarray, before: np.ndarray, dc: np.ndarray, ac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block of each lane: its coefficients in zigzag order, and the bit positions after it."""
    out = np.zeros((len(at), BLOCK), np.int32)

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = bits(ahead, at, size)
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    def symbol(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[(ahead[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        if not found.all():
            raise ValueError("no Huffman code fits")
        return found & 255, at + (found >> 8)

    size, at = symbol(dc, at)
    out[:, 0] = before + value(at, size)
    at = at + size
    lanes, end = np.arange(len(at)), at.copy()
    k = np.ones(len(at), np.int64)
    while len(lanes):
        found, at = symbol(ac, at)
        run, size = found >> 4, found & 15
        k = k + run
        stop = (size == 0) & (run < 15)
        if stop.any():
            end[lanes[stop]] = at[stop]
            go = ~stop
            lanes, at, k, size = lanes[go], at[go], k[go], size[go]
        if len(k) and k.max() >= BLOCK:
            raise ValueError("a run leaves its block")
        out[lanes, k] = value(at, size)
        at, k = at + size, k + 1
        full = k >= BLOCK
        if full.any():
            end[lanes[full]] = at[full]
            go = ~full
            lanes, at, k = lanes[go], at[go], k[go]
    return out, end


def decode(pictures: list[Picture]) -> list[dict[int, np.ndarray]]:
    """For each picture, its components' blocks in scan order; pictures of one layout are decoded together, their restart intervals in step."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, p in enumerate(pictures):
        groups[p.layout, p.interval].append(i)
    out: list[dict[int, np.ndarray]] = [{} for _ in pictures]
    for (layout, interval), members in groups.items():
        units = np.array([pictures[i].across * pictures[i].down for i in members])
        scans = [pictures[i].scan for i in members]
        data = np.concatenate([*scans, np.zeros(8, np.uint8)])
        starts = np.concatenate([[0], np.cumsum([len(x) for x in scans])])[:-1]
        after = data[1:]
        mark = np.flatnonzero(data[:-1] == 0xFF)
        restarts = mark[(after[mark] & 0xF8) == 0xD0] + 2
        begins = np.union1d(starts, restarts)
        stuffing = mark[after[mark] == 0] + 1
        data = np.delete(data, stuffing)
        begins = begins - np.searchsorted(stuffing, begins)
        wide = data.astype(np.int64)
        ahead = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        each = np.full(len(members), interval) if interval else units
        lanes = -(-units // each)
        if lanes.sum() != len(begins):
            raise ValueError("restart markers don't match the picture")
        owner = np.repeat(np.arange(len(members)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        count = np.minimum(each[owner], units[owner] - nth * each[owner])
        first = np.repeat(np.cumsum(units) - units, lanes) + nth * each[owner]
        tables = {t: lookup(t) for _, d, a in layout for t in (d, a)}
        blocks = {c: [] for c, _, _ in layout}
        where = {c: [] for c, _, _ in layout}
        per = {c: sum(x == c for x, _, _ in layout) for c in blocks}
        at, before = begins * 8, {c: np.zeros(len(begins), np.int64) for c in blocks}
        for m in range(int(count.max())):
            live = np.flatnonzero(count > m)
            seen = dict.fromkeys(blocks, 0)
            for c, d, a in layout:
                found, at[live] = decode_block(ahead, at[live], before[c][live], tables[d], tables[a])
                before[c][live] = found[:, 0]
                blocks[c].append(found)
                where[c].append((first[live] + m) * per[c] + seen[c])
                seen[c] += 1
        for c in blocks:
            order = np.concatenate(where[c])
            whole = np.empty((len(order), BLOCK), np.int32)
            whole[order] = np.concatenate(blocks[c])
            cuts = np.cumsum(units * per[c])[:-1]
            for i, part in zip(members, np.split(whole, cuts), strict=True):
                out[i][c] = part
    return out


def thumbnail(picture: Picture, blocks: np.ndarray) -> np.ndarray:
    """The luminance at an eighth of the size, from DC coefficients alone."""
    first, (h, v) = next(iter(picture.components.items()))
    dc = (blocks[:, 0].astype(np.int64) * picture.steps.get(picture.step_of[first], 1)).reshape(picture.down, picture.across, v, h).transpose(0, 2, 1, 3).reshape(picture.down * v, picture.across * h)
    return np.clip(dc // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 x 8 parts are brighter than the mean."""
    cells = np.zeros(64)
    for k, part in enumerate(x for row in np.array_split(thumb, 8) for x in np.array_split(row, 8, axis=1)):
        cells[k] = part.mean() if part.size else 0
    return np.packbits(cells > cells.mean()).tobytes().hex()


def encode_media(docs: DataFrame) -> DataFrame:
    """docs without text, with media: the JPEG stream of the text's bytes."""
    docs = docs.drop("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            yield with_columns(batch, {"media": pa.array(jpegs(*flat_bytes(batch.column("text"))), pa.binary())}, ("text",))

    return docs.mapInArrow(run, _schema(docs.drop("text"), "media binary"))


def media_features(media: DataFrame) -> DataFrame:
    """The rows with width, height, payload_bytes, payload_sha256, tail_crc32 and feature, all read from media."""
    names = ("width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "feature")
    media = media.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "media", CHUNK):
            pictures = [Picture(x) for x in batch.column("media").to_pylist()]
            rows = []
            for p, found in zip(pictures, decode(pictures), strict=True):
                luma = next(iter(found.values()))
                held = len(luma) if p.held is None else p.held
                payload = (luma[:held] - SHIFT).astype(np.uint8).tobytes()
                thumb = thumbnail(p, luma)
                rows.append((p.width, p.height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), f"{p.width}x{p.height}:{average_hash(thumb)}:{zlib.crc32(thumb.tobytes()):08x}"))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield with_columns(batch, {k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)}, ("media",))

    return media.mapInArrow(run, _schema(media.drop("media"), "width int, height int, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"))


def _schema(kept: DataFrame, added: str):
    from pyspark.sql.types import StructType

    return StructType([*kept.schema.fields, *StructType.fromDDL(added).fields])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a JPEG and read back."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    media = encode_media(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return media_features(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
