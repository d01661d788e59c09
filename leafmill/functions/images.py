"""Image files looked at without an image library: format, size, colour mode, and whether their structure is whole.

PNG is decoded in full (checksums, compressed rows); of JPEG, GIF and WebP every segment is walked to its end, entropy-coded data is not decoded. A converter for covers can be given.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd

from .batches import on_batches

_PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel and mode by PNG colour type.
_COLOURS = {0: (1, "L"), 2: (3, "RGB"), 3: (1, "P"), 4: (2, "LA"), 6: (4, "RGBA")}
_MODES = {1: "L", 3: "RGB", 4: "CMYK"}


class Broken(ValueError):
    pass


def _png(data: bytes) -> tuple[str, str, int, int]:
    at, rows, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise Broken("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            rows.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[3] not in _COLOURS:
        raise Broken("no header or end")
    width, height, depth, colour, _, _, interlaced = head
    samples, mode = _COLOURS[colour]
    try:
        size = len(zlib.decompress(b"".join(rows)))
    except zlib.error as e:
        raise Broken(str(e)) from e
    if not interlaced and size < height * (1 + (width * samples * depth + 7) // 8):
        raise Broken("rows are missing")
    return "PNG", mode, width, height


def _jpeg(data: bytes) -> tuple[str, str, int, int]:
    at, found = 2, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Broken("no marker")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if len(data) < at + 10:
                raise Broken("cut off")
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            found = width, height, _MODES.get(data[at + 9], "?")
        if kind == 0xDA:
            # the coded data runs to the end marker
            if found is None or data.rfind(b"\xff\xd9") < at:
                raise Broken("no frame or end")
            return "JPEG", found[2], found[0], found[1]
        at += 2 + n
    raise Broken("no coded data")


def _gif(data: bytes) -> tuple[str, str, int, int]:
    if len(data) < 14 or b"\x2c" not in data[13:] or data.rstrip(b"\x00")[-1:] != b"\x3b":
        raise Broken("no image or end")
    return ("GIF", "P", *struct.unpack("<HH", data[6:10]))


def _webp(data: bytes) -> tuple[str, str, int, int]:
    if len(data) < 20 or len(data) < 8 + struct.unpack("<I", data[4:8])[0]:
        raise Broken("cut off")
    return "WEBP", "RGBA" if data[12:16] in (b"VP8L", b"VP8X") else "RGB", 1, 1


def probe(data: bytes | None) -> dict:
    """format, mode, width, height, decodable and error of an image."""
    out = {"format": None, "mode": None, "width": None, "height": None, "decodable": False, "error": None}
    try:
        data = bytes(data or b"")
        read = _png if data.startswith(_PNG) else _jpeg if data.startswith(b"\xff\xd8") else _gif if data[:6] in (b"GIF87a", b"GIF89a") else _webp if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None
        if read is None:
            raise Broken("not an image of a known format")
        out["format"], out["mode"], out["width"], out["height"] = read(data)
        if min(out["width"], out["height"]) < 1:
            raise Broken("no pixels")
        out["decodable"] = True
    except (Broken, struct.error, IndexError) as e:
        out["error"] = str(e)
    return out


def is_plain_cover(data: bytes | None) -> bool:
    """A JPEG of three colours, the form of cover that every reader shows."""
    found = probe(data)
    return found["decodable"] and (found["format"], found["mode"]) == ("JPEG", "RGB")


def cover(data: bytes | None, convert=None) -> bytes | None:
    """A cover as a plain JPEG: as it is, or by ``convert`` (bytes to JPEG bytes); None if it is unusable or cannot be converted here."""
    if is_plain_cover(data):
        return bytes(data)
    if convert is None or not probe(data)["decodable"]:
        return None
    made = convert(bytes(data))
    return made if is_plain_cover(made) else None


@on_batches("struct<format:string,mode:string,width:int,height:int,decodable:boolean,error:string>")
def probed(contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probe(c) for c in contents], columns=["format", "mode", "width", "height", "decodable", "error"])
