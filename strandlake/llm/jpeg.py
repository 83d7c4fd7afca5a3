"""Baseline JPEG frames of any profile: tables, sampling and restarts are read from each frame.

Sequential Huffman frames of 8-bit samples (SOF0, SOF1), with one scan or one for each
component, are decoded to the samples of their first component, which is luminance. Frames
of AVI files may leave the Huffman tables out; those of the standard apply then.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the JPEG standard (ITU-T T.81, annex K.3): codes of each length, and the symbols that aren't in ascending order after the others.
_DC = {0: (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), 1: (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)}
_AC = {
    0: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    1: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
}


def _zigzag() -> np.ndarray:
    """Place in the block, row by row, of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Rows: frequencies, columns: samples of the one-dimensional transform.
COSINES = (np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)).astype(np.float32)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) of dequantised coefficients (blocks, 64) in zigzag order."""
    c = np.empty((len(coefficients), 64), np.float32)
    c[:, ZIGZAG] = coefficients
    flat = c.reshape(-1, 8) @ COSINES  # rows
    out = np.swapaxes(flat.reshape(-1, 8, 8), 1, 2).reshape(-1, 8) @ COSINES
    return np.clip(np.rint(np.swapaxes(out.reshape(-1, 8, 8), 1, 2) + 128), 0, 255).astype(np.uint8)


def lookup(lengths: tuple[int, ...] | bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(bits, symbol) for each of the next 16 bits; 0 bits where no code begins so."""
    table, code, at = [], 0, 0
    for bits, n in enumerate(lengths, 1):
        code <<= 1
        for s in symbols[at : at + n]:
            if code >> bits:
                raise ValueError("too many Huffman codes")
            table += [(bits, s)] * (1 << 16 - bits)
            code += 1
        at += n
    return table + [(0, 0)] * ((1 << 16) - len(table))


_STANDARD: dict[tuple[int, int], list[tuple[int, int]]] = {}


def standard(kind: int, number: int) -> list[tuple[int, int]]:
    """Huffman tables of the standard: kind 0 of DC, 1 of AC coefficients; number 0 luminance, 1 chrominance."""
    if number > 1:
        raise ValueError("a Huffman table is missing")
    if (kind, number) not in _STANDARD:
        if kind:
            lengths, first = _AC[number]
            head = bytes.fromhex(first)
            every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
            symbols = head + bytes(sorted(set(every) - set(head)))
        else:
            lengths, symbols = _DC[number], bytes(range(12))
        _STANDARD[kind, number] = lookup(lengths, symbols)
    return _STANDARD[kind, number]


class _Bits:
    """Bits of an entropy-coded stretch without markers; beyond its end come ones, as the standard pads."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.left = 8 * len(data)
        self.data, self.at = data + b"\xff" * 8, 0

    def peek(self) -> int:
        byte, bit = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 3], "big") >> 8 - bit & 0xFFFF

    def symbol(self, table: list[tuple[int, int]]) -> int:
        bits, s = table[self.peek()]
        if not bits:
            raise ValueError("no such Huffman code")
        self.at += bits
        if self.at > self.left:
            raise ValueError("a scan ends early")
        return s

    def signed(self, size: int) -> int:
        """The coefficient that `size` more bits stand for."""
        if not size:
            return 0
        v = self.peek() >> 16 - size
        self.at += size
        if self.at > self.left:
            raise ValueError("a scan ends early")
        return v if v >> size - 1 else v - (1 << size) + 1


def luminance(frame: bytes) -> np.ndarray:
    """Samples (height, width) of a frame's first component. Raises ValueError for what is no such frame."""
    try:
        return _luminance(frame)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("a damaged frame") from e


def _luminance(frame: bytes) -> np.ndarray:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    quant: dict[int, np.ndarray] = {}
    huffman: dict[tuple[int, int], list[tuple[int, int]]] = {}
    parts: dict[int, tuple[int, int, int]] = {}  # component: sampling across and down, quantisation table
    found: dict[int, np.ndarray] = {}
    restart, at, size = 0, 2, (0, 0)
    while True:
        while frame[at] == 0xFF and frame[at + 1] == 0xFF:
            at += 1
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = frame[at + 1]
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        n = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = lookup(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not high or not wide:
                raise ValueError("only samples of 8 bits, and frames that state their size, are read")
            size = (high, wide)
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)}
            if any(not across or not down for across, down, _ in parts.values()):
                raise ValueError("a component without samples")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            end = at
            while not (frame[end] == 0xFF and frame[end + 1] not in (0, *range(0xD0, 0xD8))):
                end = frame.index(b"\xff", end + 1) if frame.find(b"\xff", end + 1) >= 0 else len(frame)
            scanned = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            found |= _scan(frame[at:end], scanned, size, parts, huffman, restart)
            at = end
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only sequential Huffman frames are read")
    first = next(iter(parts))
    across, _, table = parts[first]
    grid = found[first]
    high, wide = (-(-n * parts[first][k] // max(p[k] for p in parts.values())) for n, k in zip(size, (1, 0), strict=True))
    blocks = inverse(grid.reshape(-1, 64) * quant[table])
    return blocks.reshape(*grid.shape[:2], 8, 8).swapaxes(1, 2).reshape(8 * grid.shape[0], 8 * grid.shape[1])[:high, :wide]


def _scan(data: bytes, scanned: list[tuple[int, int]], size: tuple[int, int], parts: dict, huffman: dict, restart: int) -> dict[int, np.ndarray]:
    """Coefficients (rows, columns, 64) of a scan's components, in whole blocks."""
    most_across, most_down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    grids, units = {}, []
    for c, _ in scanned:
        across, down, _ = parts[c]
        if len(scanned) == 1:  # a component alone comes block by block, without padding to whole units
            rows, columns = (-(-(-(-n * f // m)) // 8) for n, f, m in zip(size, (down, across), (most_down, most_across), strict=True))
        else:
            rows, columns = -(-size[0] // (8 * most_down)) * down, -(-size[1] // (8 * most_across)) * across
        grids[c] = np.zeros((rows, columns, 64), np.int32)
    if len(scanned) == 1:
        c, tables = scanned[0]
        units = [[(c, tables, r, k)] for r in range(grids[c].shape[0]) for k in range(grids[c].shape[1])]
    else:
        for r in range(-(-size[0] // (8 * most_down))):
            for k in range(-(-size[1] // (8 * most_across))):
                units.append([(c, t, r * parts[c][1] + y, k * parts[c][0] + x) for c, t in scanned for y in range(parts[c][1]) for x in range(parts[c][0])])
    stretches = [data]
    if restart:
        stretches, low, k = [], 0, 0
        while (high := data.find(bytes([0xFF, 0xD0 + k % 8]), low)) >= 0:
            stretches.append(data[low:high])
            low, k = high + 2, k + 1
        stretches.append(data[low:])
    every = restart or len(units)
    if len(stretches) < -(-len(units) // every):
        raise ValueError("a restart is missing")
    for s, begin in enumerate(range(0, len(units), every)):
        bits, last = _Bits(stretches[s]), dict.fromkeys(grids, 0)
        for unit in units[begin : begin + every]:
            for c, tables, r, k in unit:
                dc = huffman.get((0, tables >> 4)) or standard(0, tables >> 4)
                ac = huffman.get((1, tables & 15)) or standard(1, tables & 15)
                block = grids[c][r, k]
                last[c] += bits.signed(bits.symbol(dc))
                block[0] = last[c]
                i = 1
                while i < 64:
                    s_ = bits.symbol(ac)
                    if not s_ & 15:
                        if s_ != 0xF0:
                            break
                        i += 16
                        continue
                    i += s_ >> 4
                    if i > 63:
                        raise ValueError("a block of over 64 coefficients")
                    block[i] = bits.signed(s_ & 15)
                    i += 1
    return grids
