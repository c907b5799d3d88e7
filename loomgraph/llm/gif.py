"""GIF columns: timed frames with colour histograms, decoded from LZW code streams, and lossless storage of bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, slices, texts

#: Pixels of the largest canvas that is decoded; a larger one is an error of its image (a header alone may claim
#: four billion).
MOST_PIXELS = 1 << 26
#: Widest image that encode() writes, and its most rows in a frame.
WIDTH, MOST_ROWS = 64, 16384
_GREY = bytes(c for i in range(256) for c in (i, i, i))


@dataclass
class Frame:
    """indices: the frame's own samples; pixels: the canvas (RGBA) that is shown while this frame is."""

    indices: np.ndarray
    pixels: np.ndarray | None
    delay_ms: int
    left: int
    top: int
    disposal: int
    transparent: int | None


def _join_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _split_blocks(raw: bytes) -> bytes:
    whole = len(raw) // 255 * 255
    blocks = np.empty((whole // 255, 256), np.uint8)
    blocks[:, 0] = 255
    blocks[:, 1:] = np.frombuffer(raw, np.uint8, whole).reshape(-1, 255)
    rest = raw[whole:]
    return blocks.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _codes(raw: np.ndarray, first_bit: int, count: int, width: int) -> np.ndarray:
    """`count` codes of `width` bits (least significant first) from a bit on. raw has at least 4 spare bytes."""
    bits = first_bit + width * np.arange(count, dtype=np.int64)
    byte = bits >> 3
    word = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16
    return word >> (bits & 7) & ((1 << width) - 1)


_LITERALS = [bytes((i,)) for i in range(256)]


def _segment(codes: list[int], clear: int, most: int) -> bytes:
    """Samples of the codes between two clear codes (one code at least), `most` of them if there are so many, or more.

    Each code but the first adds an entry to the string table: what the code before it stands for and the first
    sample of its own string. A code may name the entry that it is about to add."""
    if codes[0] >= clear:
        raise ValueError("a code refers to an entry that is not there yet")
    table = _LITERALS[:clear] + [b"", b""]
    add, n, before = table.append, clear + 2, table[codes[0]]
    parts = [before]
    for code in codes[1 : 4096 - clear - 1]:
        if code < n:
            entry = table[code]
            add(before + entry[:1])
        elif code == n:
            entry = before + before[:1]
            add(entry)
        else:
            raise ValueError("a code refers to an entry that is not there yet")
        parts.append(entry)
        before = entry
        n += 1
    made = sum(map(len, parts))
    for at in range(len(parts), len(codes), 4096):  # the table is full
        if made >= most:
            break
        entries = [table[c] for c in codes[at : at + 4096]]
        made += sum(map(len, entries))
        parts += entries
    return b"".join(parts)


def lzw_decode(raw: bytes, bits: int, count: int) -> np.ndarray:
    """`count` samples from a GIF code stream of minimum code size `bits` (2 to 8)."""
    if not 2 <= bits <= 8:
        raise ValueError("the code size is not one of a GIF")
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(raw + b"\0\0\0\0", np.uint8)
    stop_bit, bit, width = 8 * len(raw), 0, bits + 1
    out: list[bytes] = []
    have, segment, more = 0, [], True
    while more and have < count:
        # The width follows the number of codes since the last clear, so codes of one width are read at once.
        room = (1 << width) - end - len(segment) if width < 12 else 4096
        take = min(max(room, 1), (stop_bit - bit) // width)
        codes = _codes(data, bit, take, width) if take > 0 else np.empty(0, np.int64)
        special = np.flatnonzero((codes == clear) | (codes == end))
        used = int(special[0]) if len(special) else len(codes)
        segment += codes[:used].tolist()
        bit += used * width
        if len(special) or take <= 0 or len(segment) >= count - have:
            if segment:
                out.append(_segment(segment, clear, count - have))
                have += len(out[-1])
            segment = []
            more = bool(len(special)) and codes[used] == clear
            bit += width
            width = bits + 1
        elif width < 12:
            width += 1
    if have < count:
        raise ValueError("the code stream ends early")
    return np.frombuffer(b"".join(out), np.uint8, count)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """A code stream of samples below 2 ** bits. The table grows to 4096 entries, then a clear code begins a new one."""
    clear = 1 << bits
    codes, places, table = [clear << 8], [0], {}
    # Numbers of entries are kept shifted by the bits of a sample, so that a key is one of them with a sample.
    find, emit, free, full = table.get, codes.append, clear + 2 << 8, 4096 << 8
    rest = iter(samples)
    prefix = next(rest, -1) << 8
    for sample in rest:
        key = prefix | sample
        if code := find(key):
            prefix = code
            continue
        emit(prefix)
        prefix = sample << 8
        if free < full:
            table[key] = free
            free += 256
        else:
            places.append(len(codes))
            emit(clear << 8)
            table.clear()
            free = clear + 2 << 8
    if prefix >= 0:
        emit(prefix)
    emit(clear + 1 << 8)
    # A code is as wide as the newest entry's number; entry clear + 2 + i comes with code i after a clear code.
    all_ = np.array(codes, np.int64) >> 8
    starts = np.array(places, np.int64)
    since = np.arange(len(all_)) - np.repeat(starts, np.diff(np.append(starts, len(all_)))) - 1  # -1: a clear code
    newest = np.minimum(clear + 1 + since, 4095)
    widths = np.maximum(bits + 1, np.floor(np.log2(np.maximum(newest, 1))).astype(np.int64) + 1)
    widths[starts[1:]] = 12  # written while the old table is full
    widths[0] = bits + 1
    at = np.cumsum(widths) - widths
    value, byte = all_ << (at & 7), at >> 3
    size = int(at[-1] + widths[-1] + 7) >> 3
    # Codes share no bits, so sums of their bytes are exact.
    packed = sum(np.bincount(byte + i, (value >> 8 * i & 255).astype(np.float64), size + 3) for i in range(3))
    return packed[:size].astype(np.uint8).tobytes()


def encode(payload: bytes, delay_ms: int = 100) -> bytes:
    """Store bytes, a positive multiple of 64 of them, as the 8-bit samples of grey frames of width 64."""
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    height = min(rows, MOST_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GREY]
    for top in range(0, rows, height):
        part = samples[top * WIDTH : (top + height) * WIDTH]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _split_blocks(lzw_encode(part.tobytes()))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, render: bool = True, most_pixels: int = MOST_PIXELS) -> list[Frame]:
    """Frames of a GIF. With render, disposal and transparency are applied to a canvas for each frame's pixels."""
    return list(walk(data, render, most_pixels))


def walk(data: bytes, render: bool = True, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of decode(), one after another. Canvases and frames beyond `most_pixels` are a ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > most_pixels:
        raise ValueError("the canvas is too large")
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8) if render else None
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _join_blocks(data, at + 2)
            if label == 0xF9:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = hundredths * 10, bits >> 2 & 7, index if bits & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = palette
        if bits & 0x80:
            n = 3 << (bits & 7) + 1
            own, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if own is None or w * h > most_pixels:
            raise ValueError("a frame has no palette" if own is None else "a frame is too large")
        size = data[at]
        raw, at = _join_blocks(data, at + 1)
        indices = lzw_decode(raw, size, w * h).reshape(h, w)
        if bits & 0x40:  # interlaced: rows 0, 8, ..., then 4, 12, ..., 2, 6, ..., 1, 3, ...
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        shown = None
        if render:
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = indices[: part.shape[0], : part.shape[1]]
            opaque = np.ones(seen.shape, bool) if transparent is None else seen != transparent
            part[opaque, :3] = own[seen[opaque]]
            part[opaque, 3] = 255
            shown = canvas.copy()
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
        yield Frame(indices, shown, delay, left, top, disposal, transparent)
        delay, disposal, transparent = 0, 0, None


def histogram(values: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of 8-bit values in equal bins."""
    return np.bincount(values.ravel(), minlength=256).reshape(bins, -1).sum(1).tolist()


_MADE = ["frame", "start_ms", "delay_ms", "width", "height", "disposal", "rgba", "red", "green", "blue", "error"]


def frames(media: DataFrame, key: str = "media_id", data: str = "gif", bins: int = 16, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """Rows of timed frames of media(key, binary data): frame number, start and delay in ms, size, disposal, the
    canvas as RGBA bytes and a histogram of each colour.

    A null or unreadable image, and one beyond `most_pixels`, gives one row with its error after the frames before
    it. Repeated keys each give their own rows; further columns are dropped; an empty table gives no rows. A key
    called like a column of the result is a ValueError.
    """
    if key in _MADE:
        raise ValueError(f"the key must not be called {key}")
    kind = media.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, frame int, start_ms long, delay_ms long, width int, height int, disposal int, rgba binary, red array<long>, green array<long>, blue array<long>, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, start = [], 0
                raw = batch.column(1)[i].as_py()
                try:
                    for n, f in enumerate(walk(bytes(raw or b""), most_pixels=most_pixels)):
                        seen = f.pixels[f.pixels[..., 3] > 0]
                        rows.append((n, start, f.delay_ms, f.pixels.shape[1], f.pixels.shape[0], f.disposal, f.pixels.tobytes(), *(histogram(seen[:, c], bins) for c in range(3)), None))
                        start += f.delay_ms
                except (ValueError, IndexError, TypeError, OverflowError, struct.error) as e:
                    rows.append((None,) * 10 + (str(e) or "truncated",))
                columns = list(zip(*rows))
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
                keys = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, types))], [key, *_MADE])

    return map_batches(media.select(key, data), read, schema)


def read_back(data: bytes) -> tuple[bytes, int, int, list[int]]:
    """Samples of all frames, number of frames, duration in ms, and the histogram of grey values (the mean of the
    colours) where each frame lies on its canvas."""
    samples, n, ms, counts = [], 0, 0, np.zeros(16, np.int64)
    for f in walk(data):
        h, w = f.indices.shape
        seen = f.pixels[f.top : f.top + h, f.left : f.left + w]
        counts += histogram(seen[seen[..., 3] > 0][:, :3].sum(1, dtype=np.uint16) // 3)
        samples.append(f.indices.tobytes())
        n, ms = n + 1, ms + f.delay_ms
    return b"".join(samples), n, ms, counts.tolist()


def text_media(docs: DataFrame) -> DataFrame:
    """Store each whole text of docs(doc_id, text) as a GIF and read it back.

    The UTF-8 bytes, with zero bytes up to a positive multiple of 64, are the samples of grey frames. Returns
    doc_id, n_bytes, gif (binary), payload (binary, as read back), n_frames, duration_ms and histogram. A null
    text is an empty one; repeated rows stay; further columns are dropped; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4 << 20):
            made, back, sizes, counts, lasts, bins = [], [], [], [], [], []
            for text in texts(batch):
                raw = text.encode()
                sizes.append(len(raw))
                gif = encode(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                payload, n_frames, ms, seen = read_back(gif)
                made.append(gif), back.append(payload), counts.append(n_frames), lasts.append(ms), bins.append(seen)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, t) for x, t in zip((sizes, made, back, counts, lasts, bins), types))], ["doc_id", "n_bytes", "gif", "payload", "n_frames", "duration_ms", "histogram"])

    return map_batches(docs.select("doc_id", "text"), store, "doc_id long, n_bytes long, gif binary, payload binary, n_frames long, duration_ms long, histogram array<long>")
