"""Ogg containers in a binary column: page checksums, lacing, logical streams, granule times.

``store`` writes the bytes of a text as unsigned 8-bit mono samples into an Ogg physical stream with two
logical streams: the samples, in packets of 576 with the running sample count as granule position, and
a stream of marks that holds the unpadded size. ``demultiplex`` reads any Ogg bytes: it verifies each
page's CRC, resynchronises after damaged bytes, joins packets over pages from their lacing values, and
keeps for each packet the time at which its page ends.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# Fixed values of the Ogg page header: capture pattern, header size, flags.
CAPTURE, HEADER = b"OggS", 27
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, FRAME, PAD = 8000, 576, b"\xff"
SAMPLES, MARKS = 1, 2
# Byte-wise and 32-bit bit reversal.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from zero and without final xor.

    zlib's CRC has the same polynomial, reflected: over bit-reversed bytes its state is the reversed one.
    """
    state = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(state.to_bytes(4, "little").translate(REVERSED), "big")


def pages(serial: int, packets: list[bytes], granules: list[int], segments: int = 255) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream: the first packet alone, then up to ``segments`` lacing values a page."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    head_values = len(packets[0]) // 255 + 1
    cuts = [*range(0, head_values, segments), *range(head_values, len(lacing), segments), len(lacing)]
    body, at, done, out, open_packet = b"".join(packets), 0, 0, [], False
    for number, (k, end) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = lacing[k:end]
        size, ended = sum(part), len(part) - part.count(255)
        done += ended
        flags = CONTINUED * open_packet | FIRST * (number == 0) | LAST * (end == len(lacing))
        granule = granules[done - 1] if ended else -1
        head = struct.pack("<4sBBqIII", CAPTURE, 0, flags, granule, serial, number, 0) + bytes([len(part)]) + part
        page = head + body[at : at + size]
        out.append((granule, page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]))
        open_packet, at = bool(part) and part[-1] == 255, at + size
    return out


def multiplex(streams: list[list[tuple[int, bytes]]]) -> bytes:
    """Pages of several logical streams: all first pages, then the others in order of their granule."""
    rest = sorted(((granule, k, i, page) for k, stream in enumerate(streams) for i, (granule, page) in enumerate(_filled(stream)) if i), key=lambda x: x[:3])
    return b"".join([stream[0][1] for stream in streams] + [x[3] for x in rest])


def _filled(stream: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Granules never falling, so that the order within a stream holds: -1 becomes the last one before."""
    out, last = [], 0
    for granule, page in stream:
        last = max(last, granule)
        out.append((last, page))
    return out


@dataclass
class Logical:
    """What was read of one logical stream."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    closed: bool = False
    partial: list[bytes] | None = None
    sequence: int = -1


def demultiplex(data: bytes) -> tuple[dict[int, Logical], int]:
    """Logical streams by serial number, and the number of damaged pages or stretches.

    A page whose checksum fails is skipped; a packet that needs it is dropped and counts as a gap of its stream.
    Every packet carries its page's granule; -1 where no packet ends on the page.
    """
    streams: dict[int, Logical] = {}
    at, damaged, n = 0, 0, len(data)
    while at < n:
        if data[at : at + 4] != CAPTURE or at + HEADER > n or data[at + 4]:
            found = data.find(CAPTURE, at + 1)
            damaged, at = damaged + 1, n if found < 0 else found
            continue
        _, _, flags, granule, serial, sequence, crc = struct.unpack_from("<4sBBqIII", data, at)
        count = data[at + 26]
        lacing = data[at + HEADER : at + HEADER + count]
        start = at + HEADER + count
        end = start + sum(lacing)
        if len(lacing) < count or end > n or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            found = data.find(CAPTURE, at + 4)
            damaged, at = damaged + 1, n if found < 0 else found
            continue
        s = streams.setdefault(serial, Logical())
        if sequence != s.sequence + 1 and s.sequence >= 0 or (flags & CONTINUED) and s.partial is None:
            s.gaps += 1
            s.partial = None
        skip = bool(flags & CONTINUED) and s.partial is None
        s.partial = s.partial if flags & CONTINUED and s.partial is not None else None
        s.sequence, s.pages, s.closed = sequence, s.pages + 1, s.closed or bool(flags & LAST)
        first = start
        for value in lacing:
            start += value
            if value < 255:
                if not skip:
                    s.packets.append(b"".join([*s.partial, data[first:start]]) if s.partial else data[first:start])
                    s.granules.append(granule)
                s.partial, skip, first = None, False, start
        if first < start and not skip:
            s.partial = [*(s.partial or []), data[first:start]]
        elif first == start and lacing and lacing[-1] < 255:
            s.partial = None
        at = end
    return streams, damaged


def encode(text: bytes) -> bytes:
    """The Ogg bytes of one text."""
    payload = text + PAD * (-len(text) % FRAME or (0 if text else FRAME))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    head = struct.pack("<8sHHI", b"PCM8MONO", 8, 1, RATE)
    sound = pages(SAMPLES, [head, *frames], [0, *range(FRAME, len(payload) + 1, FRAME)])
    marks = pages(MARKS, [b"MARKS\0", str(len(text)).encode()], [0, len(payload)])
    return multiplex([sound, marks])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media: binary) for every row, to be written; a null text is stored as the empty one.

    Repeated rows are stored each, with equal bytes. Empty table: no rows. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(encode, utf8(part.column(1))), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def features(media: bytes) -> tuple:
    """n_bytes, payload and feature string of stored media, from the bytes alone."""
    streams, damaged = demultiplex(media)
    sound, marks = streams[SAMPLES], streams[MARKS]
    payload = b"".join(sound.packets[1:])
    rate = struct.unpack("<8sHHI", sound.packets[0])[3]
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.float32) - 128
    rms, crossings = float(np.sqrt(np.dot(y, y) / len(y))), int(np.count_nonzero(np.diff(x > 127)))
    said = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};damaged={damaged};gaps={sound.gaps + marks.gaps};packets={len(sound.packets) - 1};seconds={sound.granules[-1] / rate:.3f};mean={int(x.sum(dtype=np.int64)) / len(x):.4f};rms={rms:.3f};crossings={crossings}"
    return int(marks.packets[1]), payload, said


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, media), one row each, in any order. Empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            rows = []
            for stored in batch.column(1):
                stored = stored.as_py()
                n, payload, said = features(stored)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), said))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return media.select("doc_id", "media").mapInArrow(run, OUT)
