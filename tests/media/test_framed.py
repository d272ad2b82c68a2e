"""ADTS and Ogg as relations against the serial readers, on whole, odd and broken sources."""

import random

import pytest

from lodestream import status as S
from lodestream.functions import checksums
from lodestream.sources import encode, framed, longstreams, media


def repaired(data):
    """The pages of a broken stream with their checksums put right, as far as they can be walked."""
    out, at = bytearray(data), 0
    form = longstreams.OGG_PAGES
    places = dict(zip(*(x.tolist() for x in form.places(bytes(data))), strict=True))
    while at in places and at + places[at] <= len(out):
        page = bytes(out[at : at + places[at]])
        out[at + 22 : at + 26] = checksums.OGG.of(page[:22] + b"\0\0\0\0" + page[26:]).to_bytes(4, "little")
        at += places[at]
    return bytes(out)


def cases(kind):
    rng = random.Random(11)
    if kind == "adts":
        whole = [encode.adts([rng.randbytes(n) for n in (5, 0, 30)]), encode.adts([b"x"]), encode.adts([b"\xff\xf1\x50\x80\x40\x1f\xfc"] * 4), encode.adts([b"ab"] * 256), encode.adts([b"ab"] * 257)]
    else:
        whole = [encode.ogg_opus([b"\x08" + rng.randbytes(n) for n in (5, 0, 30)]), encode.ogg_vorbis([(b"\0" + rng.randbytes(n), 100 * k) for k, n in enumerate((5, 1, 30))]), encode.ogg_opus([]), encode.ogg_opus([b"\x08a"] * 256), encode.ogg_opus([b"\x08a"] * 257), encode.ogg_vorbis([])]
    broken = []
    for base in whole[:3]:
        for _ in range(70):
            d = bytearray(base)
            for _ in range(rng.randint(1, 2)):
                d[rng.randrange(len(d))] = rng.choice([0, 1, 2, 255, rng.randrange(256)])
            broken.append(bytes(d) if kind == "adts" or rng.random() < 0.2 else repaired(d))
        broken += [base[: rng.randrange(1, len(base))] for _ in range(8)] + [base + base]
    return [*whole, *broken, b"", None, b"RIFF....", b"OggS"]


@pytest.mark.parametrize("limits", [S.LIMITS, S.Limits(packets=300, pages=5, frames=3)], ids=["default", "other"])
@pytest.mark.parametrize("kind", ["adts", "ogg"])
def test_equal_to_the_serial_reader(spark, kind, limits):
    data = cases(kind)
    sources = spark.createDataFrame([(str(k), None if d is None else bytearray(d)) for k, d in enumerate(data)], "source_id string, content binary").repartition(4)
    form, read = (longstreams.ADTS, framed.adts) if kind == "adts" else (framed.OGG, framed.ogg)
    found = read(framed.walked(sources, form), limits).persist()
    packets = {}
    for r in framed.packets(found).orderBy("source_id", "seq").collect():
        packets.setdefault(int(r.source_id), []).append((r.byte_offset, r.byte_size, r.track_id, int(r.timestamp_ticks), r.duration_ticks, r.flags))
    codes = {int(r.source_id): (r.code, r.n_packets) for r in framed.statuses(found).collect()}
    good, wanted = 0, {S.ADTS} if kind == "adts" else {S.OGG}
    assert len(codes) == len(data)
    for k, d in enumerate(data):
        status, container, _, want = media.index(d or b"", limits=limits)
        if container not in wanted | {0}:
            status, want = S.UNSUPPORTED, []
        want = want if status == 0 else []
        assert codes[k] == (status, len(want)) and packets.get(k, []) == want, (k, codes[k], status, d)
        good += status == 0
    assert good >= (4 if limits is S.LIMITS else 1)
    found.unpersist()
