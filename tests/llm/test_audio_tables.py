"""Seek tables of both variable-bitrate headers, and checksums of Layers I and II over built streams."""

import random
import struct

import pytest

from volpanel.llm import mpeg_audio as M


def bits_of(data):
    return "".join(f"{b:08b}" for b in data)


def plain_crc(bits):
    value = 0xFFFF
    for b in bits:
        top = value >> 15 ^ int(b)
        value = (value << 1 & 0xFFFF) ^ (M.CRC_POLYNOMIAL if top else 0)
    return value


def built(layer, mode, extension, index, seed, version=3, rate=1):
    """A protected frame of random data, with the checksum of what its layer protects, counted bit by bit."""
    draw = random.Random(seed)
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, index << 4 | rate << 2, mode << 6 | extension << 4))
    size = M.parse_header(head)[2]
    body = bytes(draw.choice((0, draw.randrange(256))) for _ in range(size - 6))
    bits, channels = bits_of(body), 1 if mode == 3 else 2
    bound = 4 * extension + 4 if mode == 1 else 32
    if layer == 1:
        n = sum(4 * (channels if k < bound else 1) for k in range(32))
    else:
        n, used = 0, 0
        for k, size_k in enumerate(M.allocation_bits(head)):
            for _ in range(channels if k < bound else 1):
                on = "1" in bits[n : n + size_k]
                n += size_k
                used += on * (2 if channels == 2 and k >= bound else 1)
        n += 2 * used
    crc = plain_crc(bits_of(head[2:]) + bits[:n])
    return head + struct.pack(">H", crc) + body, n


@pytest.mark.parametrize("layer", [1, 2])
@pytest.mark.parametrize(("mode", "extension"), [(0, 0), (1, 0), (1, 2), (2, 0), (3, 0)])
def test_checksums_of_layers_one_and_two(layer, mode, extension):
    for version, index in ((3, 10), (3, 6), (2, 8)):
        frames = [built(layer, mode, extension, index, seed, version) for seed in range(4)]
        data = b"".join(f for f, _ in frames)
        found = M.probe(data)
        assert (found["frames"], found["checked"], found["bad_crc"], found["skipped"]) == (4, 4, 0, 0)
        frame, n = frames[1]
        for bit, bad in ((0, 1), (n - 1, 1), (n, 0)):  # within and just behind what is protected
            if layer == 2 and bit == 0:
                continue  # would change how much is protected
            torn = bytearray(data)
            torn[len(frame) + 6 + bit // 8] ^= 128 >> bit % 8
            assert M.probe(bytes(torn))["bad_crc"] == bad


def test_tables_of_allocation():
    sizes = {head: len(M.allocation_bits(bytes(head))) for head in ((0xFF, 0xFC, 0xA4, 0), (0xFF, 0xFC, 0xA0, 0), (0xFF, 0xFC, 0x14, 0xC0), (0xFF, 0xFC, 0x18, 0xC0), (0xFF, 0xF4, 0x84, 0))}
    assert list(sizes.values()) == [27, 30, 8, 12, 30]


def test_table_of_xing():
    payload, _ = M.padded("words and words " * 3000)
    found = M.probe(M.encode(payload))
    table = found["vbr_seek"]
    assert len(table) == 100 and table == sorted(table) and table[0] == 0 and table[-1] < found["vbr_bytes"]
    # Each entry is within a 256th of where its hundredth of the frames begins.
    frame = M.HEAD + M._frame_start(M.FULL)[1]
    assert all(abs(t - found["frames"] * i // 100 * frame) <= found["vbr_bytes"] // 100 + frame for i, t in enumerate(table))


def test_table_of_vbri():
    frame, room = M._frame_start(M.FULL)
    steps = [3, 5, 7, 2]
    note = b"VBRI" + struct.pack(">HHH", 1, 0, 75) + struct.pack(">II", 9999, 17) + struct.pack(">4H", len(steps), 100, 2, 4) + struct.pack(">4H", *steps)
    first = bytearray(frame + bytes(room))
    first[36 : 36 + len(note)] = note
    data = bytes(first) + (frame + bytes(room)) * 17
    found = M.probe(data)
    assert found["vbr_frames"] == 17 and found["vbr_bytes"] == 9999 and found["vbr_seek"] == [0, 300, 800, 1500, 1700]
    assert M.read_steps(b"") == [] and M.read_steps(struct.pack(">4H", 9, 1, 2, 1)) == [] and M.read_steps(struct.pack(">4H", 2, 1, 0, 1)) == []
