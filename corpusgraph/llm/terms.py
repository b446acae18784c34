"""Terms of texts: runs of kept signs, only A-Z lower-cased, cut on the bytes of UTF-8."""

from __future__ import annotations

from collections.abc import Callable


def cutter(digits: bool) -> Callable[[bytes], list[bytes]]:
    """A function from a text's UTF-8 bytes to its terms: letters and all signs from U+0080 on, and 0-9 if digits.

    Every other byte becomes a blank; bytes of longer signs are all above 0x7F, so no sign is ever cut.
    """
    keep = b"abcdefghijklmnopqrstuvwxyz" + (b"0123456789" if digits else b"") + bytes(range(0x80, 0x100))
    table = bytearray(b" " * 256)
    for b in keep:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    table = bytes(table)
    return lambda data: data.translate(table).split()
