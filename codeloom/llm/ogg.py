"""Media columns in the Ogg container: writing, verifying, demultiplexing.

Samples are unsigned 8-bit PCM. A payload is cut into packets of 576 bytes; even
and odd packets go to two logical streams, whose pages alternate in the file.
Reading checks every page's checksum, joins packets from the lacing values,
parts the logical streams by serial number and takes times from the granule
positions (samples so far, divided by the rate of the header packet).

Defined results: a null or empty text has a payload of one packet of 255s; the
stored form depends on the text alone, so equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, texts_of

#: Fixed values of the container: page header, flags of a stream's first and last page and of a continued packet.
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: Bytes of a packet; samples a second; serial numbers of the two logical streams.
PACKET, RATE, SERIALS = 576, 8000, (0x0A11, 0x0B22)
_MAGIC = b"PCMU8\x00\x00\x00"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from zero.

    It is the mirrored CRC-32 of the mirrored bytes, which zlib computes.
    """
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(struct.pack("<I", x).translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets come with the granule position at their end.

    The first packet has the first page for itself. A packet of n bytes has n // 255
    lacing values of 255 and one of n % 255; a page holds 255 values at most, so a
    packet may go on over several pages, and a page on which none ends has granule -1.
    """
    out: list[bytes] = []
    values, body, granule, continued = bytearray(), [], -1, False
    last = len(packets) - 1
    for k, (packet, end) in enumerate(packets):
        at, left = 0, bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        while left:
            room = 255 - len(values)
            some, left = left[:room], left[room:]
            size = min(sum(some), len(packet) - at)
            body.append(packet[at : at + size])
            at += size
            values += some
            if not left:
                granule = end
            if len(values) == 255 or k == 0 and not left or k == last and not left:
                flags = CONTINUED * continued | FIRST * (not out) | LAST * (k == last and not left)
                out.append(_page(serial, len(out), flags, granule, bytes(values), b"".join(body)))
                values, body, granule, continued = bytearray(), [], -1, bool(left)
    return out


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the others in turn."""
    todo = [pages(serial, packets) for serial, packets in streams.items() if packets]
    out = [p.pop(0) for p in todo]
    while any(todo):
        out += [p.pop(0) for p in todo if p]
    return b"".join(out)


def demux(data: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream; each with the granule position of its page if it is the last to end there."""
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    open_: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    ended: set[int] = set()
    at, view = 0, memoryview(data)
    while at < len(data):
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if magic != b"OggS" or version or end > len(data):
            raise ValueError(f"no page at byte {at}")
        if page_crc(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise ValueError(f"the page at byte {at} fails its checksum")
        if (flags & FIRST > 0) != (serial not in numbers) or number != numbers.get(serial, -1) + 1 or serial in ended:
            raise ValueError(f"the page at byte {at} is out of order in its stream")
        numbers[serial] = number
        if (flags & CONTINUED > 0) != bool(open_.get(serial)):
            raise ValueError(f"the page at byte {at} doesn't go on where its stream stopped")
        packets, part = streams.setdefault(serial, []), open_.setdefault(serial, [])
        size, p, done = 0, start, 0
        for value in lacing:
            size += value
            if value < 255:
                part.append(data[p : p + size])
                packets.append((b"".join(part), None))
                part.clear()
                p, size, done = p + size, 0, done + 1
        if size or n and lacing[-1] == 255:
            part.append(data[p : p + size])
        if done:
            packets[-1] = (packets[-1][0], granule)
        if flags & LAST:
            ended.add(serial)
        at = end
    if any(open_.values()) or ended != set(numbers):
        raise ValueError("a stream has no end")
    return streams


def store(payload: bytes) -> bytes:
    """An Ogg file of 8-bit samples; whole packets, dealt to two streams in turn."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = {}
    for which, serial in enumerate(SERIALS):
        own = packets[which :: len(SERIALS)]
        header = _MAGIC + struct.pack("<IIII", RATE, PACKET, which, len(own))
        streams[serial] = [(header, 0), *((p, (k + 1) * PACKET) for k, p in enumerate(own))]
    return mux(streams)


def load(media: bytes) -> tuple[bytes, float]:
    """The payload and the seconds that it lasts, from the granule positions."""
    parts, last = {}, 0.0
    for packets in demux(media).values():
        head = packets[0][0]
        if head[:8] != _MAGIC:
            raise ValueError("unknown codec")
        rate, _, which, n = struct.unpack("<IIII", head[8:])
        if n != len(packets) - 1:
            raise ValueError("packets are missing")
        parts[which] = [p for p, _ in packets[1:]]
        granules = [g for _, g in packets[1:] if g is not None]
        if granules:
            last += granules[-1] / rate
    turns = max(map(len, parts.values()), default=0)
    return b"".join(parts[w][k] for k in range(turns) for w in sorted(parts) if k < len(parts[w])), last


def features(payload: bytes, seconds: float) -> str:
    """Duration, mean, root mean square and share of crossings of the middle level."""
    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "0.0000|0.0000|0.0000|0.0000"
    counts = np.bincount(x, minlength=256).astype(np.int64)
    level = np.arange(256)
    mean, rms = (counts @ level) / len(x), float(np.sqrt((counts @ (level - 128) ** 2) / len(x)))
    side = x >= 128
    cross = np.count_nonzero(side[1:] != side[:-1]) / max(1, len(x) - 1)
    return f"{seconds:.4f}|{mean:.4f}|{rms:.4f}|{cross:.4f}"


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = True) -> DataFrame:
    """Per row: key, sizes, digests, the Ogg bytes (``media``) and the features read back. No shuffle."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {fields}" + (", media binary" if with_media else "")
    names = [x.split()[0] for x in fields.split(", ")] + ["media"] * with_media

    def one(batch):
        out = {key: batch.column(0)} | {n: [] for n in names}
        for raw in texts_of(batch, "__text"):
            media = store(raw + b"\xff" * (PACKET * max(1, -(-len(raw) // PACKET)) - len(raw)))
            payload, seconds = load(media)
            row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, seconds), media)
            for n, v in zip(names, row):
                out[n].append(v)
        return out

    return map_rows(docs.select(docs[key].alias(key), docs[text].alias("__text")), one, schema)
