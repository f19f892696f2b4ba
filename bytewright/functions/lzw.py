"""LZW as in GIF: least significant bit first, codes of up to 12 bits, a clear and an end code."""

from __future__ import annotations


def decode(data: bytes, literal_bits: int = 8, limit: int = 1 << 30) -> tuple[bytes, int]:
    """Decoded bytes and bytes read, up to the end code."""
    from bytewright.functions.codecs import Refused

    clear, end = 1 << literal_bits, (1 << literal_bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    words, width, before = list(base), literal_bits + 1, b""
    out, size, held, bits, at = [], 0, 0, 0, 0
    while True:
        while bits < width:
            if at >= len(data):
                raise Refused("Truncated", "unexpected end")
            held |= data[at] << bits
            bits, at = bits + 8, at + 1
        code, held, bits = held & (1 << width) - 1, held >> width, bits - width
        if code == clear:
            words, width, before = list(base), literal_bits + 1, b""
            continue
        if code == end:
            return b"".join(out), at
        if code < len(words) and code != clear:
            word = words[code]
        elif code == len(words) and before:
            word = before + before[:1]
        else:
            raise Refused("InvalidStream", "code")
        out.append(word)
        size += len(word)
        if size > limit:
            raise Refused("OutputTooSmall", "max_output")
        if before and len(words) < 4096:
            words.append(before + word[:1])
            if len(words) == 1 << width and width < 12:
                width += 1
        before = word
