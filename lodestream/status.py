"""Status codes of sources and of decoded packets, and limits."""

from dataclasses import dataclass

OK = 0
INVALID = -1
UNSUPPORTED = -2
MALFORMED = -3
#: Of reads by position; they are the codes of the reading interface, in which -3 is a buffer too small and cannot occur here.
SOURCE_FAILED = -4
SOURCE_STALLED = -5
CANCELLED = -6

#: Bounds above which a source is rejected whole (never cut).
MAX_SOURCE_BYTES = 4 * 1024 * 1024
MAX_TRACKS = 32
MAX_PACKETS = 256
MAX_PACKET_BYTES = 1024 * 1024
MAX_OGG_PAGES = 4096
MAX_ADTS_FRAMES = 65_536


@dataclass(frozen=True)
class Limits:
    """What a source may have at most before it is rejected whole; the defaults are those of the interface."""

    packets: int = MAX_PACKETS
    tracks: int = MAX_TRACKS
    pages: int = MAX_OGG_PAGES
    frames: int = MAX_ADTS_FRAMES


LIMITS = Limits()

#: Container and codec ids, and kinds of tracks.
MP4, WEBM, MATROSKA, AVI, WAV, FLAC, OGG, ADTS = range(1, 9)
CODECS = [(1, "wav"), (2, "mp3"), (3, "flac"), (4, "ogg"), (5, "opus"), (6, "aac"), (7, "m4a")]
UNKNOWN_TRACK, AUDIO, VIDEO, SUBTITLE = range(4)
KEYFRAME = 1
NO_GRANULE = 2**64 - 1
