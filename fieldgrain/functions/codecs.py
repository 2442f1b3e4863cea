"""Image files to arrays and back, on the standard library and numpy: PNG, TIFF, BMP. Header sizes without pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class ImageLoadError(ValueError):
    """The bytes are no image that can be read."""


PNG, BMP = b"\x89PNG\r\n\x1a\n", b"BM"


def kind_of(raw: bytes) -> str:
    if raw[:8] == PNG:
        return "png"
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if raw[:2] == BMP:
        return "bmp"
    if raw[:3] == b"\xff\xd8\xff":
        raise ImageLoadError("JPEG files are not supported")
    raise ImageLoadError("not an image file that can be read")


def read(raw: bytes) -> tuple[np.ndarray, bool]:
    """(array, whether its first axis is frames)."""
    try:
        kind = kind_of(raw)
        return {"png": _png, "tiff": _tiff, "bmp": _bmp}[kind](raw)
    except ImageLoadError:
        raise
    except Exception as e:  # damaged files fail in many ways; each is an unreadable image
        raise ImageLoadError(f"damaged image file: {e}") from e


def size_of(raw: bytes) -> tuple[int, int]:
    """(width, height) from the header alone."""
    try:
        kind = kind_of(raw)
        if kind == "png":
            return struct.unpack(">II", raw[16:24])
        if kind == "bmp":
            w, h = struct.unpack("<ii", raw[18:26])
            return w, abs(h)
        tags = next(_directories(raw))
        return tags[256][0], tags[257][0]
    except ImageLoadError:
        raise
    except Exception as e:
        raise ImageLoadError(f"damaged image file: {e}") from e


# ---- PNG


def _unfilter(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + before
        elif kind == 1:
            now = np.add.accumulate(np.pad(line, (0, -stride % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            cur, up, src = bytearray(stride), before.tobytes(), line.tobytes()
            for i in range(stride):
                a, b, c = (cur[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = ((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
                    guess = min(near)[2]
                cur[i] = (src[i] + guess) & 255
            now = np.frombuffer(bytes(cur), np.uint8)
        else:
            raise ImageLoadError(f"unknown PNG filter {kind}")
        out[y] = before = now
    return out


def _samples(rows: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Unsigned samples of 1 to 16 bits from big-endian packed rows."""
    if depth == 8:
        return rows
    if depth == 16:
        return rows.reshape(len(rows), -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    bits = np.unpackbits(rows, axis=1)
    n = bits.shape[1] // depth
    values = bits[:, : n * depth].reshape(len(rows), n, depth) @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
    return values[:, :width]


def _png(raw: bytes) -> tuple[np.ndarray, bool]:
    at, data, palette, head = 8, b"", None, None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ImageLoadError("interlaced PNG files are not supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    bits = channels * depth
    rows = _unfilter(zlib.decompress(data), height, -(-width * bits // 8), max(1, bits // 8))
    a = _samples(rows, width * channels, depth).reshape(height, width, channels)
    if colour == 3:
        return palette[a[..., 0]], False
    if depth < 8:
        a = (a.astype(int) * 255 // (2**depth - 1)).astype(np.uint8)
    return (a[..., 0] if colour in (0, 4) else a), False


def write_png(a: np.ndarray) -> bytes:
    """uint8 or uint16, gray, RGB or RGBA."""
    wide = a.dtype == np.uint16
    colour = {2: 0, 3: {3: 2, 4: 6}.get(a.shape[-1])}[a.ndim]
    rows = a.astype(">u2" if wide else np.uint8).reshape(a.shape[0], -1).view(np.uint8).reshape(a.shape[0], -1)
    body = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16 if wide else 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def to_png(a: np.ndarray) -> bytes:
    """8-bit images as they are; others by their peak if it is over 1, and clipped."""
    if a.dtype != np.uint8:
        a = a.astype(np.float64)
        peak = float(np.nanmax(a)) if a.size else 0.0
        a = np.round(np.clip(np.nan_to_num(a / peak if peak > 1 else a), 0, 1) * 255).astype(np.uint8)
    return write_png(a)


# ---- TIFF


def _directories(raw: bytes):
    order = "<" if raw[:2] == b"II" else ">"
    kinds = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
    at, seen = struct.unpack(order + "I", raw[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", raw[at : at + 2])
        tags: dict = {"order": order}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind not in kinds:
                continue
            size = struct.calcsize(kinds[kind]) * count
            start = at + 10 + 12 * i
            if size > 4:
                start = struct.unpack(order + "I", raw[start : start + 4])[0]
            tags[tag] = struct.unpack(f"{order}{count}{kinds[kind]}", raw[start : start + size])
        yield tags
        at = struct.unpack(order + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def _unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _lzw(raw: bytes) -> bytes:
    out, table, last, width, bits, held = bytearray(), [], None, 9, 0, 0
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            if code == 256:
                table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], None, 9
                continue
            if code == 257:
                return bytes(out)
            now = table[code] if code < len(table) else last + last[:1]
            out += now
            if last is not None:
                table.append(last + now[:1])
            last, width = now, max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def _page(raw: bytes, tags: dict) -> np.ndarray:
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    depth, coding, form = tags.get(258, (1,))[0], tags.get(259, (1,))[0], tags.get(339, (1,))[0]
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(coding)
    if unpack is None or 322 in tags or tags.get(284, (1,))[0] != 1:
        raise ImageLoadError("this TIFF layout is not supported")
    data = b"".join(unpack(raw[o : o + n]) for o, n in zip(tags[273], tags[279], strict=True))
    if depth < 8:
        stride = -(-width * channels * depth // 8)
        a = _samples(np.frombuffer(data, np.uint8)[: height * stride].reshape(height, stride), width * channels, depth)
        a = (a.astype(int) * 255 // (2**depth - 1)).astype(np.uint8).reshape(height, width, channels)
    else:
        code = {1: "u", 2: "i", 3: "f"}[form]
        a = np.frombuffer(data, np.dtype(f"{tags['order']}{code}{depth // 8}"))[: height * width * channels].reshape(height, width, channels)
        a = a.astype(a.dtype.newbyteorder("="))
        if tags.get(317, (1,))[0] == 2:
            a = np.add.accumulate(a, axis=1, dtype=a.dtype)
    if tags.get(262, (1,))[0] == 0 and a.dtype.kind == "u":
        a = np.iinfo(a.dtype).max - a
    if 320 in tags and tags.get(262, (1,))[0] == 3:
        return (np.array(tags[320]).reshape(3, -1).T[a[..., 0]] // 256).astype(np.uint8)
    return a[..., 0] if channels == 1 else a


def _tiff(raw: bytes) -> tuple[np.ndarray, bool]:
    pages = [_page(raw, t) for t in _directories(raw)]
    if not pages:
        raise ImageLoadError("a TIFF file without images")
    if len({p.shape for p in pages}) > 1:
        raise ImageLoadError("pages of different shapes")
    return np.stack(pages), True


def write_tiff(pages: np.ndarray) -> bytes:
    """Gray pages (page, height, width) of uint8 or uint16, uncompressed."""
    size, out, at = pages.dtype.itemsize, b"", 8
    for n, page in enumerate(pages):
        data = page.astype(f"<u{size}").tobytes()
        entries = [(256, page.shape[1]), (257, page.shape[0]), (258, 8 * size), (259, 1), (262, 1), (273, at), (277, 1), (278, page.shape[0]), (279, len(data))]
        head = at + len(data)
        after = head + 2 + 12 * len(entries) + 4
        out += data + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in entries) + struct.pack("<I", after + pages[0].size * size if n < len(pages) - 1 else 0)
        at = after
    first = 8 + pages[0].size * size
    return b"II*\0" + struct.pack("<I", first) + out


# ---- BMP


def _bmp(raw: bytes) -> tuple[np.ndarray, bool]:
    start, head, width, height, _, depth, coding = struct.unpack("<IIiiHHI", raw[10:34])
    if coding not in (0, 3):
        raise ImageLoadError("compressed BMP files are not supported")
    stride = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(raw, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if depth <= 8:
        used = struct.unpack("<I", raw[46:50])[0] or 2**depth
        palette = np.frombuffer(raw, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
        a = palette[_samples(rows, width, depth)[:, :width]]
        return (a[..., 0] if (palette == palette[:, :1]).all() else a), False
    return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[..., 2::-1].copy(), False


def write_bmp(a: np.ndarray) -> bytes:
    """Gray uint8."""
    h, w = a.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = a[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4)
    start = 54 + 1024
    return BMP + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette.tobytes() + rows.tobytes()
