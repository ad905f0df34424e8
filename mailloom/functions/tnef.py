"""The HTML body of a TNEF attachment (winmail.dat), by the format's public description."""

from __future__ import annotations

import struct

_SIGNATURE, _PROPERTIES, _HTML = 0x223E9F78, 0x9003, 0x1013
#: Bytes of a value by its type; the types of strings and bytes have their lengths before them.
_FIXED = {0x02: 4, 0x03: 4, 0x04: 4, 0x05: 8, 0x06: 8, 0x07: 8, 0x0A: 4, 0x0B: 4, 0x14: 8, 0x40: 8, 0x48: 16}
_VARIABLE = (0x0D, 0x1E, 0x1F, 0x102)


def _attributes(data: bytes):  # noqa: ANN202
    """Number and bytes of each attribute; what is cut off has none."""
    at = 6
    while at + 9 <= len(data):
        _, number, size = struct.unpack_from("<BII", data, at)
        if at + 9 + size > len(data):
            return
        yield number & 0xFFFF, data[at + 9 : at + 9 + size]
        at += 11 + size


def _property(data: bytes, wanted: int) -> bytes | None:
    """The first value of a property in a list of them."""
    if len(data) < 4:
        return None
    at = 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, number = struct.unpack_from("<HH", data, at)
        at += 4
        if number >= 0x8000:
            named = struct.unpack_from("<I", data, at + 16)[0]
            at += 20
            at += 4 if not named else 4 + (struct.unpack_from("<I", data, at)[0] + 3) // 4 * 4
        count = 1
        if kind & 0x1000 or kind in _VARIABLE:
            count = struct.unpack_from("<I", data, at)[0]
            at += 4
        for _ in range(count):
            size = _FIXED.get(kind & 0xFFF)
            if size is None:
                if kind & 0xFFF not in _VARIABLE:
                    return None
                size = struct.unpack_from("<I", data, at)[0]
                at += 4
            if number == wanted:
                return data[at : at + size]
            at += (size + 3) // 4 * 4
    return None


def html_body(data: bytes) -> bytes:
    """The message's HTML body; nothing if the data isn't of this format or has none."""
    if len(data) < 6 or struct.unpack_from("<I", data)[0] != _SIGNATURE:
        return b""
    for number, value in _attributes(data):
        if number == _PROPERTIES:
            try:
                found = _property(value, _HTML)
            except struct.error:
                continue
            if found:
                return found
    return b""
