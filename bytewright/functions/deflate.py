"""An inflate of our own, for what the standard library lacks: Deflate64, block boundaries, and starts in mid-stream."""

from __future__ import annotations

from dataclasses import dataclass

_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _bases(extra: list[int], first: int) -> list[int]:
    out = []
    for e in extra:
        out.append(first)
        first += 1 << e
    return out


_LENGTH_EXTRA = [0] * 8 + [e for e in range(1, 6) for _ in range(4)]
_LENGTH_BASE = _bases(_LENGTH_EXTRA, 3)
_DISTANCE_EXTRA = [0, 0] + [e for e in range(15) for _ in range(2)]
_DISTANCE_BASE = _bases(_DISTANCE_EXTRA, 1)


@dataclass
class Block:
    """Where a block begins: bit in the input, byte in the output."""

    bit: int
    out: int
    kind: int


def _codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    out, code = {}, 0
    for n in range(1, 16):
        for symbol, length in enumerate(lengths):
            if length == n:
                out[n, code] = symbol
                code += 1
        code <<= 1
    return out


def inflate(data: bytes, limit: int = 1 << 30, wide: bool = False, bit: int = 0, history: bytes = b"", blocks: list[Block] | None = None, stop: int | None = None) -> tuple[bytes, int]:
    """Decodes raw DEFLATE, or Deflate64 if ``wide``, from a bit on, with the bytes before; notes ``blocks`` on the way;
    ends with the last block, or before the first block that begins at ``stop`` decoded bytes or later."""
    from bytewright.functions.codecs import Refused

    end = 8 * len(data)
    out = bytearray(history)
    start = len(out)

    def take(n: int) -> int:
        nonlocal bit
        if bit + n > end:
            raise Refused("Truncated", "unexpected end")
        first = bit >> 3
        value = int.from_bytes(data[first : first + 5], "little") >> (bit & 7) & (1 << n) - 1
        bit += n
        return value

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise Refused("InvalidStream", "invalid code")

    length_extra, length_base = [*_LENGTH_EXTRA, 16 if wide else 0], [*_LENGTH_BASE, 3 if wide else 258]
    while True:
        if blocks is not None:
            blocks.append(Block(bit, len(out) - start, data[bit >> 3] >> (bit & 7) if bit < end else 0))
        if stop is not None and len(out) - start >= stop:
            return bytes(out[start:]), bit
        final, kind = take(1), take(2)
        if kind == 0:
            bit = bit + 7 & ~7
            n, check = take(16), take(16)
            if n != check ^ 65535:
                raise Refused("InvalidStream", "invalid stored block lengths")
            if (bit >> 3) + n > len(data):
                raise Refused("Truncated", "unexpected end")
            out += data[bit >> 3 : (bit >> 3) + n]
            bit += 8 * n
        elif kind == 3:
            raise Refused("InvalidStream", "invalid block type")
        else:
            if kind == 1:
                literals, distances = _codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _codes([5] * 32)
            else:
                n_literal, n_distance, n_code = take(5) + 257, take(5) + 1, take(4) + 4
                lengths = [0] * 19
                for i in range(n_code):
                    lengths[_ORDER[i]] = take(3)
                codes, found = _codes(lengths), []
                while len(found) < n_literal + n_distance:
                    s = symbol(codes)
                    if s < 16:
                        found.append(s)
                    elif s == 16:
                        if not found:
                            raise Refused("InvalidStream", "invalid bit length repeat")
                        found += found[-1:] * (3 + take(2))
                    else:
                        found += [0] * (3 + take(3) if s == 17 else 11 + take(7))
                if len(found) > n_literal + n_distance:
                    raise Refused("InvalidStream", "invalid bit length repeat")
                literals, distances = _codes(found[:n_literal]), _codes(found[n_literal:])
            while (s := symbol(literals)) != 256:
                if s < 256:
                    out.append(s)
                else:
                    if s > 285:
                        raise Refused("InvalidStream", "invalid literal/length code")
                    n = length_base[s - 257] + take(length_extra[s - 257])
                    d = symbol(distances)
                    if d >= (32 if wide else 30):
                        raise Refused("InvalidStream", "invalid distance code")
                    distance = _DISTANCE_BASE[d] + take(_DISTANCE_EXTRA[d])
                    if distance > len(out):
                        raise Refused("InvalidStream", "invalid distance too far back")
                    for _ in range(n):
                        out.append(out[-distance])
                if len(out) - start > limit:
                    raise Refused("OutputTooSmall", "max_output")
        if final:
            return bytes(out[start:]), bit + 7 >> 3
