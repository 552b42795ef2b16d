"""Media columns: AVI files of motion-JPEG frames, written, read by their index, decoded and cut into shots.

Writing: each byte of a payload is one 8 x 8 block of a grey baseline JPEG whose only coefficient is its DC, with a
quantiser of 8, so the block's samples are exactly that byte. A frame holds 64 x 8 blocks; each row of blocks is a
restart interval. The Huffman tables (in every frame's DHT) give a DC difference of b extra bits a code of 9 - b bits
(9 for none), and the end of block one bit, so every block takes ten bits before byte stuffing. The payload's length
stands in the file's INFO list, as the last frame is filled up with zeros.

Reading: the RIFF chunks and idx1 give the frames; a grey baseline decoder (any Huffman tables, quantisers, restart
intervals, with AC coefficients and inverse DCT) walks all restart intervals of a chunk of files in lockstep.

Shots: 16-bin histograms of each frame's samples; a frame begins a shot if its difference to the frame before exceeds a floor
and the mean plus two deviations of the differences just before it. Clips are the frames between cuts, timed at the
file's rate.

Nulls: a null text is empty; an empty payload is one unit of 64 zero bytes. Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import common as C

UNIT = 64
ACROSS, DOWN = 64, 8
FRAME = ACROSS * DOWN
FRAMES_PER_SECOND = 25
BINS, WINDOW, FLOOR = 16, 8, 0.1
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
CLIPS = "doc_id bigint, clip int, first_frame int, last_frame int, start_s double, end_s double, difference double"


class Damaged(ValueError):
    """The file breaks off, or says what this decoder does not know."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Code lengths of the written DC table: one symbol of each length 1..8 (symbols 8..1), and symbol 0 with length 9.
DC_COUNTS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, 8 * DOWN, 8 * ACROSS, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS)
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
    + _segment(0xDD, struct.pack(">H", ACROSS))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _codes() -> np.ndarray:
    """The ten bits of a block by its DC difference + 255."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        bits = abs(diff).bit_length()
        prefix = (1 << (9 - bits)) - 2 if bits else (1 << 9) - 2
        extra = diff if diff >= 0 else diff + (1 << bits) - 1
        out[diff + 255] = (prefix << bits | extra) << 1
    return out


CODES = _codes()


def jpegs(frames: np.ndarray) -> list[bytes]:
    """A JPEG for each row of FRAME bytes."""
    rows = frames.reshape(-1, ACROSS).astype(np.int64) - 128
    diff = np.diff(rows, axis=1, prepend=0)
    bits = CODES[diff + 255].reshape(-1, ACROSS // 4, 4)
    word = bits[..., 0] << np.uint64(30) | bits[..., 1] << np.uint64(20) | bits[..., 2] << np.uint64(10) | bits[..., 3]
    scan = np.empty((len(rows), ACROSS // 4 * 5 + 2), np.uint8)
    scan[:, :-2] = np.stack([(word >> np.uint64(s)).astype(np.uint8) for s in (32, 24, 16, 8, 0)], axis=-1).reshape(len(rows), -1)
    scan[:, -2] = 0xFF
    scan[:, -1] = 0xD0 + np.arange(len(rows)) % DOWN % 8
    scan[DOWN - 1 :: DOWN, -1] = 0xD9
    stuffed = scan == 0xFF
    stuffed[:, -2] = False
    size = 1 + stuffed.ravel()
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - size] = scan.ravel()
    cuts = np.concatenate([[0], end[scan.shape[1] * DOWN - 1 :: scan.shape[1] * DOWN]]).tolist()
    raw = out.tobytes()
    return [HEADER + raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes], length: int) -> bytes:
    """An AVI file of JPEG frames that stand for a payload of this length."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, len(frames), 0, 1, largest, 8 * ACROSS, 8 * DOWN, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FRAMES_PER_SECOND, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, 8 * ACROSS, 8 * DOWN)
    picture = struct.pack("<IiiHH4s5I", 40, 8 * ACROSS, 8 * DOWN, 1, 8, b"MJPG", 64 * FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % length))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        parts.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(parts[-1])
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(info) + at + 8 + 16 * len(index) + 8) + b"AVI " + head + info + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], int, float]:
    """Start and size of each frame by the index, the payload's length (-1: not stated), and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Damaged("no AVI file")
    movi, frames, length, rate = None, None, -1, float(FRAMES_PER_SECOND)
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise Damaged(f"chunk {name!r} breaks off")
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                elif kind in (b"hdrl", b"INFO"):
                    todo.append((at + 12, at + 8 + size))
            elif name == b"avih":
                rate = 1e6 / max(1, struct.unpack_from("<I", data, at + 8)[0])
            elif name == b"ICMT" and data[at + 8 : at + 16] == b"payload=":
                length = int(data[at + 16 : at + 8 + size].rstrip(b"\0"))
            elif name == b"idx1":
                frames = [(o, n) for tag, _, o, n in struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size]) if tag[2:] in (b"dc", b"db")]
            at += 8 + size + (size & 1)
    if movi is None or frames is None:
        raise Damaged("no movi list or no index")
    if frames and data[movi + frames[0][0] : movi + frames[0][0] + 4] == data[frames[0][0] : frames[0][0] + 4] or not frames:
        base = movi
    else:  # offsets count from the list's start, or in some writers from the file's
        base = movi if data[movi + frames[0][0] + 2 : movi + frames[0][0] + 4] in (b"dc", b"db") else 0
    return [(base + o + 8, n) for o, n in frames], length, rate


def _lookup(body: bytes) -> np.ndarray:
    """Symbol << 8 | code length by the next 16 bits; 0 where there is no such code."""
    table = np.zeros(1 << 16, np.int32)
    code = at = 0
    for size in range(1, 17):
        for symbol in body[16 + at : 16 + at + body[size - 1]]:
            table[code << (16 - size) : (code + 1) << (16 - size)] = symbol << 8 | size
            code += 1
        at += body[size - 1]
        code <<= 1
    return table


class Header:
    """What stands before the entropy-coded data of a grey baseline JPEG."""

    def __init__(self, data: bytes):
        self.tables: dict[int, bytes] = {}
        self.quantisers: dict[int, np.ndarray] = {}
        self.restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise Damaged("no JPEG")
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    self.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1):
                depth, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if depth != 8 or parts != 1:
                    raise Damaged("only grey frames of 8 bits are read")
                self.quantiser = body[8]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise Damaged("only baseline frames are read")
            elif marker == 0xDA:
                self.dc, self.ac = _lookup(self.tables[body[2] >> 4]), _lookup(self.tables[0x10 | body[2] & 15])
                break
        self.q = self.quantisers[self.quantiser]
        self.across, self.down = (self.width + 7) // 8, (self.height + 7) // 8
        self.size = at


#: Places of the coefficients in the order of a scan: along the antidiagonals, turning at the edges.
ZIGZAG = np.array([8 * r + c for _, _, r, c in sorted((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8))])
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def decode_blocks(header: Header, scans: list[bytes]) -> np.ndarray:
    """Blocks of frames that share a header: frames x blocks x 64 samples, or x 1 if no frame has AC coefficients."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    sizes = np.array([len(s) for s in scans])
    begin = np.cumsum(sizes) - sizes
    escape = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[escape + 1]
    drop = np.zeros(len(raw), bool)
    drop[escape[after == 0] + 1] = True
    mark = escape[(after >= 0xD0) & (after <= 0xD7)]
    drop[mark], drop[mark + 1] = True, True
    place = np.concatenate([[0], np.cumsum(~drop)])
    starts = place[np.sort(np.concatenate([begin, mark + 2]))]
    data = np.concatenate([raw[~drop], np.full(8, 255, np.uint8)]).astype(np.int64)
    window = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    blocks = header.across * header.down
    step = header.restart or blocks
    per_frame = -(-blocks // step)
    if len(starts) != per_frame * len(scans):
        raise Damaged("restart markers are missing")
    n = len(starts)
    count = np.minimum(step, blocks - np.arange(n) % per_frame * step)
    dc = np.zeros((n, step), np.int64)
    ac: np.ndarray | None = None
    bit = starts.astype(np.int64) * 8

    def symbol(table: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here = bit[rows]
        if len(here) and int(here.max()) >> 3 >= len(window):
            raise Damaged("a scan breaks off")
        w, shift = window[here >> 3], here & 7
        entry = table[(w >> (24 - shift)) & 0xFFFF]
        size, value = entry & 255, entry >> 8
        if not size.all():
            raise Damaged("no such code")
        extra = value & 15
        got = (w >> (40 - shift - size - extra)) & ((1 << extra) - 1)
        bit[rows] = here + size + extra
        return value, np.where(got < (1 << extra) >> 1, got - (1 << extra) + 1, got), extra

    for block in range(step):
        rows = np.flatnonzero(count > block) if block >= count.min() else slice(None)
        dc[rows, block] = symbol(header.dc, rows)[1]
        todo = np.arange(n)[rows]
        k = np.ones(len(todo), np.int64)
        while len(todo):
            value, coefficient, extra = symbol(header.ac, todo)
            if not value.any():
                break
            keep = (value != 0) & (k < 64)
            todo, k, value, coefficient, extra = (x[keep] for x in (todo, k, value, coefficient, extra))
            k = k + (value >> 4)
            at = np.flatnonzero((extra > 0) & (k < 64))
            if len(at):
                if ac is None:
                    ac = np.zeros((n, step, 64))
                ac[todo[at], block, k[at]] = coefficient[at]
            k = k + 1
            todo, k = todo[k < 64], k[k < 64]
    inside = np.arange(step) < count[:, None]
    level = np.cumsum(dc, axis=1)[inside].reshape(len(scans), blocks) * header.q[0]
    if ac is None:
        return np.clip(np.rint(level / 8) + 128, 0, 255).astype(np.uint8)[:, :, None]
    flat = np.zeros((len(scans) * blocks, 64))
    flat[:, ZIGZAG] = ac[inside] * header.q
    flat[:, 0] = level.ravel()
    samples = COSINES @ flat.reshape(-1, 8, 8) @ COSINES.T
    return np.clip(np.rint(samples) + 128, 0, 255).astype(np.uint8).reshape(len(scans), blocks, 64)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The first sample of each block of each frame (frames of one size): frames x blocks."""
    headers: dict[bytes, tuple[Header, list[int]]] = {}
    known: dict[int, bytes] = {}
    for i, frame in enumerate(frames):
        key = next((k for k in known.values() if frame.startswith(k)), None)
        if key is None:
            header = Header(frame)
            key = known[len(known)] = frame[: header.size]
            headers[key] = (header, [])
        headers[key][1].append(i)
    out: np.ndarray | None = None
    for header, own in headers.values():
        got = decode_blocks(header, [frames[i][header.size : -2] for i in own])[:, :, 0]
        if out is None:
            out = np.zeros((len(frames), got.shape[1]), np.uint8)
        out[own] = got
    return out if out is not None else np.zeros((0, FRAME), np.uint8)


def differences(samples: np.ndarray, used: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Half the distance of each frame's histogram to the one before, 0 to 1; 0 for a file's first frame."""
    n = len(samples)
    bins = (samples >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    shown = np.arange(samples.shape[1]) < used[:, None]
    share = np.bincount(bins[shown], minlength=BINS * n).reshape(n, BINS) / np.maximum(used, 1)[:, None]
    out = np.zeros(n)
    out[1:] = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    out[first] = 0
    return out


def cuts(difference: list[float]) -> list[int]:
    """Frames that begin a shot: the first, and those whose difference stands out from the ones just before."""
    found = [0]
    for i in range(1, len(difference)):
        near = difference[max(1, i - WINDOW) : i]
        mean = sum(near) / len(near) if near else 0.0
        spread = (sum((x - mean) ** 2 for x in near) / len(near)) ** 0.5 if near else 0.0
        if difference[i] > max(FLOOR, mean + 2 * spread):
            found.append(i)
    return found


def write_files(texts: C.Texts) -> tuple[list[bytes], np.ndarray]:
    """A file for each text, and the payloads' lengths."""
    sizes = np.diff(texts.offsets)
    length = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
    n_frames = -(-length // FRAME)
    ends = np.cumsum(n_frames)
    filled = np.zeros(int(ends[-1]) * FRAME, np.uint8)
    filled[C.ragged((ends - n_frames) * FRAME, sizes)] = texts.data
    made = jpegs(filled.reshape(-1, FRAME))
    return [avi(made[e - n : e], size) for e, n, size in zip(ends.tolist(), n_frames.tolist(), length.tolist())], length


def read_files(files: list[bytes]) -> tuple[list[bytes], list[list[float]], list[float]]:
    """Payload, frame differences and frames a second of each file."""
    frames: list[bytes] = []
    counts, lengths, rates = [], [], []
    for data in files:
        where, length, rate = parse_avi(data)
        frames += [data[a : a + n] for a, n in where]
        counts.append(len(where))
        lengths.append(length)
        rates.append(rate)
    samples = decode_frames(frames)
    ends = np.cumsum(counts)
    first = (ends - counts)[np.array(counts) > 0]
    size = samples.shape[1]
    used = np.full(len(samples), size)
    for end, n, length in zip(ends.tolist(), counts, lengths):
        if n and length >= 0:
            used[end - 1] = length - (n - 1) * size
    difference = differences(samples, used, first).tolist()
    payloads = [samples[e - n : e].tobytes()[: length if length >= 0 else None] for e, n, length in zip(ends.tolist(), counts, lengths)]
    return payloads, [difference[e - n : e] for e, n in zip(ends.tolist(), counts)], rates


def store(docs: DataFrame) -> DataFrame:
    """doc_id and its text as a media file."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "media": pa.array(write_files(C.Texts.of(batch.column("text")))[0], pa.binary())}

    return C.map_texts(docs.select("doc_id", "text"), "doc_id bigint, media binary", work)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of media(doc_id, media); a null file has none."""
    C.prepare(media.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                files = [(i, m) for i, m in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist()) if m is not None]
                if not files:
                    continue
                _, difference, rates = read_files([m for _, m in files])
                rows = []
                for (doc, _), own, rate in zip(files, difference, rates):
                    begins = cuts(own) if own else []
                    rows += [(doc, k, a, b - 1, a / rate, b / rate, own[a]) for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(own)]))]
                names = [x.split()[0] for x in CLIPS.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_pydict({k: pa.array([r[j] for r in rows], kinds[j]) for j, k in enumerate(names)})

    return media.select("doc_id", "media").mapInArrow(run, CLIPS)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every text, reads it back from the stored bytes and describes both."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = C.Texts.of(batch.column("text"))
        files, _ = write_files(texts)
        payloads, difference, _ = read_files(files)
        feature = []
        for own in difference:
            begins = cuts(own)
            spans = ",".join(f"{a}-{b - 1}" for a, b in zip(begins, [*begins[1:], len(own)]))
            feature.append(f"frames={len(own)};shots={len(begins)};clips={spans};peak={max(own):.6f}")
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array(np.diff(texts.offsets)),
            "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
            "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
            "media_bytes": pa.array([len(f) for f in files], pa.int64()),
            "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
            "feature": feature,
        }

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA, work)
