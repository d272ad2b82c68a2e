"""Readers against files written by encoders that share nothing with them."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream import status as S
from lodestream.functions import codecs
from lodestream.plans.queries import MAKERS
from lodestream.sources import bits, boxes, encode, flac, media, riff, streams

SIZES = [5, 1, 9, 30, 2]
EXPECT = {"wav": S.WAV, "avi": S.AVI, "flac": S.FLAC, "adts": S.ADTS, "opus": S.OGG, "vorbis": S.OGG, "mp4": S.MP4, "webm": S.WEBM, "laced": S.MATROSKA}


@pytest.mark.parametrize("kind", sorted(MAKERS))
def test_index(kind):
    data = MAKERS[kind](SIZES)
    status, container, tracks, packets = media.index(data)
    assert (status, container) == (0, EXPECT[kind]) and len(tracks) == 1
    offsets = [p[0] for p in packets]
    assert offsets == sorted(offsets) and all(p[0] + p[1] <= len(data) for p in packets)


@pytest.mark.parametrize("kind", sorted(MAKERS))
def test_every_truncation_is_rejected_whole_or_consistent(kind):
    data = MAKERS[kind](SIZES)
    whole = media.index(data)[3]
    for n in range(len(data)):
        status, _, tracks, packets = media.index(data[:n])
        if status:
            assert not tracks and not packets
        else:  # formats without a total: a prefix of whole packets (or trailing bytes that no table names)
            assert packets == whole[: len(packets)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(MAKERS)), st.integers(0, 10_000), st.integers(0, 255))
def test_flipped_bytes_never_crash(kind, at, value):
    data = bytearray(MAKERS[kind](SIZES))
    data[at % len(data)] = value
    status, _, tracks, packets = media.index(bytes(data))
    assert status == 0 or (not tracks and not packets)
    codecs.decode_source(bytes(data))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes(data):
    assert media.index(data)[0] != 0 or media.index(data)[3] is not None


def test_limits_reject_and_never_cut():
    assert media.index(encode.wav(b"\0\0" * 256))[0] == 0
    assert media.index(encode.wav(b"\0\0" * 257)) == (S.UNSUPPORTED, S.WAV, [], [])
    assert len(riff.wav_packets(encode.wav(b"\0\0" * 1000), 100)) == 10
    assert media.index(encode.adts([b"x"] * 256))[0] == 0 and media.index(encode.adts([b"x"] * 257))[0] == S.UNSUPPORTED
    assert media.inspect(encode.adts([b"x"] * 257))[0] == 0
    assert media.inspect(b"RIFF" + b"\0" * (4 * 1024 * 1024)) == (S.INVALID, 0, [])
    assert media.index(b"") == (S.INVALID, 0, [], [])


def test_laces():
    frames = [b"a", b"bb", b"ccc" * 100, b"dddd"]
    for kind, lace in ((1, encode.xiph_lace), (3, encode.ebml_lace)):
        body = lace(frames)
        sizes, at = boxes.lace_sizes(body, 0, len(body), kind)
        assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)
    body = encode.fixed_lace([b"ab", b"cd", b"ef"])
    assert boxes.lace_sizes(body, 0, len(body), 2)[0] == [2, 2, 2]
    # three Xiph laces of 1, 2, 3 bytes: the last size takes all preceding ones off
    body = encode.xiph_lace([b"1", b"22", b"333"])
    assert boxes.lace_sizes(body, 0, len(body), 1)[0] == [1, 2, 3]
    # a single laced frame is the rest of the block
    assert boxes.lace_sizes(b"\0abc", 0, 4, 3) == ([3], 1)


def test_clusters_of_unknown_size_end_at_the_next():
    data = encode.mkv([(1, [encode.element(0xA3, encode.block(b"xy"))]), (2, [encode.element(0xA3, encode.block(b"z"))])])
    cluster = bytes.fromhex("1f43b675")
    first = data.index(cluster)
    opened = data[: first + 4] + b"\x01" + b"\xff" * 7 + data[first + 12 :]
    assert [p[3] for p in boxes.mkv_packets(opened)] == [1, 2]


def test_block_groups():
    group = encode.element(0xA0, encode.element(0xA1, encode.block(b"pay", 3, 0)) + encode.uint(0x9B, 40) + encode.element(0xFB, b"\1"))
    ((at, size, track, time, duration, flags),) = boxes.mkv_packets(encode.mkv([(100, [group])]))
    assert (size, track, time, duration, flags) == (3, 1, 103, 40, 0)


def test_mp4_tables():
    parts = [b"aa", b"b", b"cccc", b"d", b"ee"]
    data = encode.mp4(parts, [10, 20, 30, 40, 50], shifts=[5, -5, 0, 0, 1], keys=[1, 4], per_chunk=2, wide=True)
    got = boxes.mp4_packets(data)
    assert [p[3] for p in got] == [5, 5, 30, 60, 101] and [p[5] for p in got] == [1, 0, 0, 1, 0]
    assert [data[p[0] : p[0] + p[1]] for p in got] == parts
    assert media.index(encode.mp4(parts, [10, 20, 30, 40, 50], shifts=[-1, 0, 0, 0, 0]))[0] == S.UNSUPPORTED
    assert media.index(encode.mp4(parts, [10, 0, 30, 40, 50]))[0] == S.UNSUPPORTED
    moved = encode.box(b"free", b"") + data  # a box before ftyp: probed as MP4, not inspected
    assert media.probe(moved) == S.MP4 and media.inspect(moved)[0] == S.UNSUPPORTED


def test_ogg_checks():
    data = encode.ogg_opus([b"\x08ab", b"\x0b\x03abcdef"])
    assert [p[4] for p in streams.ogg_packets(data)] == [960, 2880]
    assert media.inspect(data[:-1] + b"?")[0] == S.UNSUPPORTED  # checksum
    for packet, ticks in ((b"\x00a", 480), (b"\x01ab", 960), (b"\x02\x01ab", 960), (b"\x83\x82\x01ab", 240), (b"\x83\x41\x02a\0\0", 120)):
        assert streams.opus_duration(packet) == ticks
    for bad in (b"", b"\x01a", b"\x02\x09a", b"\x03", b"\x03\x00", b"\x1b\x3fa" + b"a" * 62, b"\x00" + b"a" * 1276):
        with pytest.raises(bits.Bad):
            streams.opus_duration(bad)


def test_aac():
    c = streams.aac_config(bytes([0x12, 0x10]))
    assert (c.object_type, c.rate, c.channels, c.sbr) == (2, 44100, 2, -1)
    word = f"{5:05b}{7:04b}{2:04b}{4:04b}{2:05b}000".ljust(32, "0")
    c = streams.aac_config(int(word, 2).to_bytes(4, "big"))
    assert (c.object_type, c.rate, c.extension_rate, c.sbr) == (2, 22050, 44100, 1)
    with pytest.raises(bits.Bad):  # escape value 32
        streams.aac_config(int("11111" + "000000" + "0100" + "0010" + "0" * 5, 2).to_bytes(3, "big"))


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, p):
        z = v << 1 if v >= 0 else -v * 2 - 1
        self.bits += "0" * (z >> p) + "1"
        self.put(z, p)


def flac_file(channels, n, body, assignment, depth=16):
    """A file of one frame; ``body`` writes the subframes."""
    info = struct.pack(">HH", n, n) + b"\0" * 6 + (8000 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + b"\0" * 16
    head = bytes([0xFF, 0xF8, 0x60, assignment << 4, 0, n - 1])
    head += bytes([encode._crc(head, 7, 8)])
    w = Writer()
    body(w)
    w.bits += "0" * (-len(w.bits) % 8)
    frame = head + int(w.bits, 2).to_bytes(len(w.bits) // 8, "big")
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + frame + struct.pack(">H", encode._crc(frame, 0x8005, 16))


def verbatim(w, values, n):
    w.put(0b00000010, 8)
    for v in values:
        w.put(v, n)


def test_flac_predictors_and_stereo():
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.integers(-30, 30, 32)).tolist()

    def fixed2(w):
        w.put(0b0 << 7 | (8 + 2) << 1, 8)
        for v in x[:2]:
            w.put(v, 16)
        w.put(0, 2)
        w.put(0, 4)
        w.put(5, 4)
        for k in range(2, 32):
            w.rice(x[k] - 2 * x[k - 1] + x[k - 2], 5)

    assert flac.decode(flac_file(1, 32, fixed2, 0))[:, 0].tolist() == x

    def lpc(w):  # order 2, coefficients 3 and -1 over 2, escape-coded residuals, one wasted bit
        y = [v * 2 for v in x]
        w.put((31 + 2) << 1 | 1, 8)
        w.put(1, 1)
        for v in x[:2]:
            w.put(v, 15)
        w.put(4, 4)
        w.put(1, 5)
        w.put(3, 5)
        w.put(-1, 5)
        w.put(0, 2)
        w.put(0, 4)
        w.put(15, 4)
        w.put(12, 5)
        for k in range(2, 32):
            w.put(x[k] - ((3 * x[k - 1] - x[k - 2]) >> 1), 12)
        return y

    assert flac.decode(flac_file(1, 32, lpc, 0))[:, 0].tolist() == [v * 2 for v in x]
    left, right = x, [v // 3 + 5 for v in x]
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    for assignment, first, second, wide in ((8, left, side, 1), (9, side, right, 0), (10, mid, side, 1)):
        def body(w, first=first, second=second, wide=wide):
            verbatim(w, first, 17 if wide == 0 else 16)
            verbatim(w, second, 17 if wide == 1 else 16)

        got = flac.decode(flac_file(2, 32, body, assignment))
        assert got[:, 0].tolist() == left and got[:, 1].tolist() == right
    broken = bytearray(flac_file(1, 32, fixed2, 0))
    broken[-5] ^= 1
    assert codecs.decode_source(bytes(broken))[0] != 0


def test_flac_constant_and_depths():
    for depth in (8, 12, 20, 24):
        low = -(1 << (depth - 1))
        assert flac.decode(encode.flac([[low, -1 - low]] * 5, bits=depth)).tolist() == [[low, -1 - low]] * 5
    assert flac.decode(encode.flac([[-7]] * 100, constant=True, block=40)).ravel().tolist() == [-7] * 100


def test_pcm():
    assert codecs.pcm_to_s16(bytes([0, 128, 255]), 1, 8).tolist() == [-32768, 0, 32512]
    assert codecs.pcm_to_s16(bytes([0, 128, 255]), 1, 8, signed8=True).tolist() == [0, -32768, -256]
    assert codecs.pcm_to_s16(struct.pack("<3i", -65537, -1, 65536), 1, 32).tolist() == [-2, -1, 1]
    assert codecs.pcm_to_s16((-257).to_bytes(3, "little", signed=True), 1, 24).tolist() == [-2]
    assert codecs.pcm_to_s16(struct.pack("<4f", 2, -2, 0.5, -0.99999), 3, 32).tolist() == [32767, -32767, 16383, -32766]
    for bad in (struct.pack("<f", float("nan")), struct.pack("<f", float("inf")), b"\0\0\0"):
        with pytest.raises(bits.Bad):
            codecs.pcm_to_s16(bad, 3, 32)
    # decoding is monotone in the code's size and symmetric; the legacy polarity is the negative
    assert (codecs._alaw(False) == -codecs._alaw(True)).all() and codecs._alaw(False)[0xD5] == 8 and codecs._ulaw()[0xFF] == 0 and codecs._ulaw()[0] == -32124


def test_packet_tables_are_checked_whole():
    data = encode.wav(struct.pack("<6h", 1, -2, 3, -4, 5, -6), channels=2)
    packets = media.index(data)[3]
    assert codecs.decode_packets(data, packets, 1, 16, 2, 3).tolist() == [[1, -2], [3, -4], [5, -6]]
    at, size, track, time, duration, flags = packets[1]
    for bad in ((at - 1, size, track, time, duration, flags), (at, size - 1, track, time, duration, flags), (at, size, 2, time, duration, flags), (at, size, track, time + 1, duration, flags), (at, size, track, time, 2, flags)):
        with pytest.raises(bits.Bad):
            codecs.decode_packets(data, [packets[0], bad, packets[2]], 1, 16, 2, 3)
    with pytest.raises(bits.Bad):
        codecs.decode_packets(data, packets, 1, 16, 2, 4)


def test_ima():
    block = struct.pack("<hBB", 100, 0, 0) + bytes([0x10, 0x32, 0x54, 0x76])
    got = codecs.ima_block(block, 1)[:, 0].tolist()
    assert len(got) == 9 and got[0] == 100 and got == sorted(got)
    with pytest.raises(bits.Bad):
        codecs.ima_block(struct.pack("<hBB", 0, 89, 0) + b"\0" * 4, 1)
    stereo = struct.pack("<hBBhBB", 5, 88, 0, -5, 0, 0) + b"\x77" * 4 + b"\xff" * 4
    got = codecs.ima_block(stereo, 2)
    assert got.shape == (9, 2) and got[-1, 0] == 32767 and got[-1, 1] < -5


def test_wav_rules():
    fmt = struct.pack("<H", 22) + struct.pack("<HI", 16, 0) + struct.pack("<H", 1) + riff._GUID_TAIL
    assert riff.open_wav(encode.wav(b"\0\0", riff.EXTENSIBLE, extra=fmt)).tag == 1
    assert media.inspect(encode.wav(b"\0\0", riff.EXTENSIBLE, extra=fmt[:-1] + b"?"))[0] == S.UNSUPPORTED
    assert media.inspect(encode.wav(b"\0" * 3))[0] == S.UNSUPPORTED
    assert media.inspect(encode.wav(b"\0" * 6, channels=3))[0] == S.UNSUPPORTED


def test_avi_lookup_and_frames():
    pixels = bytes(range(24))
    data = encode.avi([(b"00db", pixels), (b"01wb", b"\0" * 20), (b"00db", pixels[::-1]), (b"01wb", b"\0" * 12)], audio=True)
    assert riff.nth_frame(data, 1) == pixels[::-1]
    assert riff.audio_at(data, 0) == (0, 0, 10) and riff.audio_at(data, 1) == (0, 8, 2)
    with pytest.raises(bits.Bad):
        riff.audio_at(data, 2)
    frame = codecs.raw_frame(pixels, 4, 2, 24)
    assert frame[1, 0] == 0xFF020100 and frame[0, 0] == 0xFF0E0D0C
    assert codecs.raw_frame(struct.pack("<2H", 0xF800, 0x001F), 2, 1, 16, bgr=False).tolist() == [[0xFFF80000, 0xFF0000F8]]
    assert codecs.raw_frame(bytes([1, 2, 3, 4]), 1, 1, 32).tolist() == [[0x04030201]]


def test_checksums():
    assert bits.crc8(b"123456789") == 0xF4 and bits.crc16(b"123456789") == 0xFEE8
    assert bits.fnv1a(b"V_VP8") == 3404789108
    assert bits.crc16(b"6789", bits.crc16(b"12345")) == bits.crc16(b"123456789")
