"""Media columns as MPEG audio: write, resynchronise, verify, index.

A payload is stored losslessly in the ancillary data of MPEG-1 Layer III frames (48 kHz,
mono, CRC-protected, with empty side information, which decoders play as silence), behind
an ID3v2 tag and a variable-bitrate header frame.  The probe reads such bytes, or any
stream of MPEG audio frames: it skips tags and rubbish until two frame headers agree, walks
the frames, verifies their checksums and stores the exact duration and seek offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.frames import arrow_map

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer), Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

RATE, SAMPLES = 48000, 1152
HEAD = 4 + 2 + 17  # header, CRC and mono side information
FULL = 14  # index of the largest bitrate; its frames take 960 bytes
UNIT = 64
SEEK_EVERY = 256  # frames between stored seek offsets
MIN_AGREE = 2


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
    return value


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> tuple[int, int, int, int, int, bool, bool] | None:
    """(version, layer, bytes of the frame, Hz, samples, protected, mono) of four header bytes."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate, index, slack = head[2] >> 2 & 3, head[2] >> 4, head[2] >> 1 & 1
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15):
        return None
    hz, kbit = RATES[version][rate], BITRATES[version == 3, layer][index]
    if layer == 1:
        size, samples = (12 * kbit * 1000 // hz + slack) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * kbit * 1000 // hz + slack
    return version, layer, size, hz, samples, not head[1] & 1, head[3] >> 6 == 3


#: Bits of the allocation of each subband of Layer II, by table: (bits, subbands) in a row.
ALLOCATION = {
    "27": ((4, 11), (3, 12), (2, 4)), "30": ((4, 11), (3, 12), (2, 7)), "8": ((4, 2), (3, 6)), "12": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


@lru_cache(maxsize=512)
def allocation_bits(head: bytes) -> tuple[int, ...]:
    """Bits of the allocation of each subband of a Layer II frame with this header."""
    hz = RATES[head[1] >> 3 & 3][head[2] >> 2 & 3]
    kbit = BITRATES[head[1] >> 3 & 3 == 3, 2][head[2] >> 4] // (1 if head[3] >> 6 == 3 else 2)
    if head[1] >> 3 & 3 != 3:
        name = "low"
    elif kbit <= 48:
        name = "12" if hz == 32000 else "8"
    else:
        name = "27" if kbit <= 80 or hz == 48000 else "30"
    return tuple(bits for bits, many in ALLOCATION[name] for _ in range(many))


def crc_bits(data: bytes, bits: int, value: int) -> int:
    """The checksum carried on over the first ``bits`` bits."""
    value = crc16(data[: bits // 8], value)
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        value = (value << 1 ^ CRC_POLYNOMIAL if (value >> 15 ^ bit) & 1 else value << 1) & 0xFFFF
    return value


def protected_bits(head: bytes, body: bytes) -> int | None:
    """How many bits of ``body``, which follows the checksum, it covers besides the header; None if the body is too short.

    Layer I: the allocation of 32 subbands.  Layer II: allocation, and the scale-factor
    selection of each subband that has bits.  Joint stereo shares the subbands from its bound on.
    """
    layer, mode = 4 - (head[1] >> 1 & 3), head[3] >> 6
    channels = 1 if mode == 3 else 2
    bound = 4 * (head[3] >> 4 & 3) + 4 if mode == 1 else 32
    if layer == 1:
        bits = 4 * (channels * bound + 32 - bound if channels == 2 else 32)
        return bits if bits <= 8 * len(body) else None
    sizes = allocation_bits(head)
    value, at, used = int.from_bytes(body, "big"), 0, 0
    total = 8 * len(body)
    for band, size in enumerate(sizes):
        own = channels if band < bound else 1
        for _ in range(own):
            at += size
            if at > total:
                return None
            used += (value >> (total - at) & ((1 << size) - 1) > 0) * (channels if own == 1 else 1)
    return at + 2 * used if at + 2 * used <= total else None


@lru_cache(maxsize=64)
def _frame_start(index: int) -> tuple[bytes, int]:
    """Header, CRC and side information of our frames of one bitrate, and their room for data."""
    header = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side, BITRATES[True, 3][index] * 3 - HEAD


@lru_cache(maxsize=4096)
def _last_index(size: int) -> int:
    return next(i for i in range(1, FULL + 1) if _frame_start(i)[1] >= size)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """MPEG audio bytes that hold ``payload``: tag, variable-bitrate header, data frames."""
    start, room = _frame_start(FULL)
    whole, rest = divmod(len(payload), room)
    body = bytearray((whole * (HEAD + room)))
    if whole:
        grid = np.empty((whole, HEAD + room), np.uint8)
        grid[:, :HEAD] = np.frombuffer(start, np.uint8)
        grid[:, HEAD:] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
        body = bytearray(grid.tobytes())
    if rest:
        index = _last_index(rest)
        head, space = _frame_start(index)
        body += head + payload[whole * room :] + bytes(space - rest)
    frames, size = whole + bool(rest), len(body)
    head, space = _frame_start(_last_index(140))
    table = bytes(min(255, 256 * ((frames * i // 100) * (HEAD + room)) // max(size, 1)) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, frames, size + HEAD + space) + table
    note = b"\x00" + b"payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _synchsafe(len(note)) + b"\x00\x00" + note
    return b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame + head + xing + bytes(space - len(xing)) + bytes(body)


def read_tag(data: bytes) -> tuple[int, int | None]:
    """End of the leading ID3v2 tag, and the payload size it notes."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, None
    end = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at, noted = 10, None
    while at + 10 <= end and data[at : at + 4].isalnum():
        # Frame sizes are plain numbers before version 2.4 of the tag, and seven bits a byte from then on.
        steps = (21, 14, 7, 0) if data[3] >= 4 else (24, 16, 8, 0)
        size = sum(b << s for b, s in zip(data[at + 4 : at + 8], steps, strict=True))
        note = data[at + 25 : at + 10 + size]
        if data[at : at + 4] == b"TXXX" and data[at + 11 : at + 25] == b"payload_bytes\x00" and note.isdigit():
            noted = int(note)
        at += 10 + size
    return end, noted


def resynchronise(data: bytes, at: int) -> int:
    """First position from ``at`` where frame headers of one kind follow each other; -1 if none."""
    while (at := data.find(b"\xff", at)) >= 0:
        here, follow = parse_header(data[at : at + 4]), at
        for _ in range(MIN_AGREE):
            if here is None:
                break
            follow += here[2]
            after = parse_header(data[follow : follow + 4])
            if follow == len(data) or data[follow : follow + 3] == b"TAG":
                return at
            if after is None or (after[0], after[1], after[3]) != (here[0], here[1], here[3]):
                break
            here = after
        else:
            return at
        at += 1
    return -1


@lru_cache(maxsize=8192)
def _sound(protected: bytes, crc: bytes) -> bool:
    return crc16(protected) == struct.unpack(">H", crc)[0]


def read_steps(table: bytes) -> list[int]:
    """Byte offsets of a VBRI table: after entries, scale, bytes of an entry and frames of an entry come the steps."""
    if len(table) < 8:
        return []
    entries, scale, width, _ = struct.unpack(">4H", table[:8])
    steps, out = table[8 : 8 + entries * width], [0]
    if not width or width > 4 or len(steps) < entries * width:
        return []
    for k in range(0, len(steps), width):
        out.append(out[-1] + scale * int.from_bytes(steps[k : k + width], "big"))
    return out


def probe(data: bytes) -> dict:
    """Read MPEG audio bytes: frames, checksums, exact duration, seek offsets, ancillary payload.

    ``seek`` has offsets of frames as they lie, ``vbr_seek`` those that the variable-bitrate
    header gives: of the hundredths of the playing time (Xing), or of its entries (VBRI), from the first frame on.
    Checksums are verified in all three layers.
    """
    at, noted = read_tag(data)
    tag = at
    found = {"frames": 0, "checked": 0, "bad_crc": 0, "skipped": 0, "samples": 0, "hz": 0, "vbr_frames": None, "vbr_bytes": None, "vbr_seek": [], "seek": []}
    parts: list[bytes] = []
    view = memoryview(data)
    pending = resynchronise(data, at)
    found["skipped"] += max(pending, at) - at if pending >= 0 else len(data) - at
    at = pending
    while 0 <= at < len(data):
        info = parse_header(data[at : at + 4])
        if info is None or at + info[2] > len(data):
            if data[at : at + 3] == b"TAG" and len(data) - at == 128:
                break
            onward = resynchronise(data, at + 1)
            found["skipped"] += (onward if onward >= 0 else len(data)) - at
            at = onward
            continue
        version, layer, size, hz, samples, protected, mono = info
        side = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}[version == 3, mono] if layer == 3 else 0
        begin = at + 4 + 2 * protected
        if protected and layer == 3:
            found["checked"] += 1
            found["bad_crc"] += not _sound(data[at + 2 : at + 4] + data[begin : begin + side], data[at + 4 : at + 6])
        elif protected:
            body = data[begin : min(at + size, begin + 64)]
            bits = protected_bits(data[at : at + 4], body)
            found["checked"] += 1
            found["bad_crc"] += bits is None or crc_bits(body, bits, crc16(data[at + 2 : at + 4])) != struct.unpack(">H", data[at + 4 : at + 6])[0]
        begin += side
        mark = data[begin : begin + 4]
        if not found["frames"] and found["vbr_frames"] is None and mark in (b"Xing", b"Info") and begin + 16 <= len(data):
            flags = struct.unpack(">I", data[begin + 4 : begin + 8])[0]
            fields = struct.unpack(f">{(flags & 1) + (flags >> 1 & 1)}I", data[begin + 8 : begin + 8 + 4 * ((flags & 1) + (flags >> 1 & 1))])
            found["vbr_frames"] = fields[0] if flags & 1 else None
            found["vbr_bytes"] = fields[-1] if flags & 2 else None
            table = data[begin + 8 + 4 * len(fields) : begin + 108 + 4 * len(fields)]
            if flags & 4 and len(table) == 100 and flags & 2:
                found["vbr_seek"] = [b * found["vbr_bytes"] // 256 for b in table]
        elif not found["frames"] and found["vbr_frames"] is None and layer == 3 and data[at + 36 : at + 40] == b"VBRI" and at + 54 <= len(data):
            found["vbr_bytes"], found["vbr_frames"] = struct.unpack(">II", data[at + 46 : at + 54])
            found["vbr_seek"] = read_steps(data[at + 54 : at + size])
        else:
            if found["frames"] % SEEK_EVERY == 0:
                found["seek"].append(at)
            found["frames"] += 1
            found["samples"] += samples
            found["hz"] = hz
            if layer == 3:
                parts.append(view[begin : at + size])
        at += size
    payload = b"".join(parts)
    return found | {"tag_bytes": tag, "payload": payload if noted is None else payload[:noted]}


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: empty), zero-filled to a positive multiple of 64; their own number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """Media column: (doc_id, n_bytes, media) for each row of ``docs`` (doc_id, text); null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for low in range(0, batch.num_rows, 128):
                made = [padded(t) for t in texts.slice(low, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(low, 128), pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, bad_crc long, skipped_bytes long, duration_samples long, sample_rate int, vbr_frames long, seek_offsets array<long>, table_offsets array<long>"
)


def features(media: bytes) -> tuple:
    found = probe(media)
    payload = found["payload"]
    exact = f"{found['samples']}/{found['hz']}"
    seek = hashlib.sha256(struct.pack(f">{len(found['seek'])}Q", *found["seek"])).hexdigest()[:16]
    text = f"mpeg1-layer3;frames={found['frames']};seconds={exact};checked={found['checked']};bad_crc={found['bad_crc']};skipped={found['skipped']};vbr={found['vbr_frames']}:{found['vbr_bytes']};seek={seek}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), text,
        found["frames"], found["bad_crc"], found["skipped"], found["samples"], found["hz"], found["vbr_frames"], found["seek"], found["vbr_seek"],
    )


def index(media: DataFrame) -> DataFrame:
    """Probe a media column (doc_id, n_bytes, media): durations, checksums, seek offsets, digests of the payload.

    Null media read as empty.  Rows are independent: repeated rows give repeated results and
    an empty table an empty one.
    """

    schema = f"doc_id long, n_bytes long, {FEATURES}"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                rows = [(i, n, *features(m or b"")) for i, n, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, schema)


def media_of(docs: DataFrame) -> DataFrame:
    """Store every text as MPEG audio and index the stored bytes."""
    return index(store(docs))
