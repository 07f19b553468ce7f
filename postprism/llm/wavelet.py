"""A wavelet matrix: a token sequence as bit planes with rank and select, in one compressed file."""

from __future__ import annotations

import json

import numpy as np
import zstandard

MAGIC = b"WVLT0001"
_BLOCK = 512  # bits between two entries of a rank directory


class Plane:
    """Bits with the number of ones before each block of them."""

    def __init__(self, packed: np.ndarray, size: int, ranks: np.ndarray | None = None) -> None:
        self.size = size
        self.packed = packed
        self.blocks = packed.view("<u8").reshape(-1, _BLOCK // 64)
        if ranks is None:
            counts = np.bitwise_count(self.blocks).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate((np.zeros(1, dtype=np.uint32), np.cumsum(counts, dtype=np.uint32)))
        self.ranks = ranks

    @classmethod
    def of(cls, ones: np.ndarray) -> Plane:
        packed = np.packbits(ones, bitorder="little")
        short = -len(packed) % (_BLOCK // 8) or (0 if len(packed) else _BLOCK // 8)
        return cls(np.concatenate((packed, np.zeros(short, dtype=np.uint8))), len(ones))

    def bits(self, places: np.ndarray) -> np.ndarray:
        return (self.packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1

    def all_bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.size, bitorder="little").view(bool)

    def ones_before(self, places: np.ndarray) -> np.ndarray:
        block = np.minimum(places // _BLOCK, len(self.blocks) - 1)
        rest = places - block * _BLOCK
        found = self.ranks[block].astype(np.int64)
        for word in range(_BLOCK // 64):
            here = np.clip(rest - 64 * word, 0, 64).astype(np.uint64)
            mask = np.where(here == 64, np.uint64(2**64 - 1), (np.uint64(1) << (here & np.uint64(63))) - np.uint64(1))
            found += np.bitwise_count(self.blocks[block, word] & mask)
        return found

    def select(self, bit: int, numbers: np.ndarray) -> np.ndarray:
        """The places of the bits with the given numbers, from 0, among those equal to ``bit``."""
        ranks = self.ranks.astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * _BLOCK - ranks
        out = np.empty(len(numbers), dtype=np.int64)
        for i in range(0, len(numbers), 4_096):
            wanted = numbers[i : i + 4_096]
            block = np.searchsorted(before, wanted, side="right") - 1
            inside = np.unpackbits(self.blocks[block].view(np.uint8), axis=1, bitorder="little") == bit
            out[i : i + 4_096] = block * _BLOCK + (np.cumsum(inside, axis=1) == (wanted - before[block] + 1)[:, None]).argmax(axis=1)
        return out


class WaveletMatrix:
    """Tokens below ``2 ** len(planes)``: the plane of the highest bit first; each next plane has the tokens with a 0 there before
    those with a 1, in their order."""

    def __init__(self, size: int, planes: list[Plane], zeros: list[int]) -> None:
        self.size, self.planes, self.zeros = size, planes, zeros

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        tokens = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in reversed(range(bits)):
            ones = (tokens >> bit & 1).astype(bool)
            planes.append(Plane.of(ones))
            low, high = tokens[~ones], tokens[ones]
            zeros.append(len(low))
            tokens = np.concatenate((low, high))
        return cls(len(tokens), planes, zeros)

    def tokens(self) -> np.ndarray:
        """All tokens in order: the planes undone from the lowest."""
        values = np.zeros(self.size, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            ones = self.planes[level].all_bits()
            above = np.empty_like(values)
            above[~ones] = values[: self.zeros[level]]
            above[ones] = values[self.zeros[level] :]
            values = above | (ones.astype(values.dtype) << (len(self.planes) - 1 - level))
        return values

    def access(self, places: np.ndarray) -> np.ndarray:
        """The tokens at the given places."""
        at, found = np.asarray(places, dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.bits(at).astype(np.int64)
            ones = plane.ones_before(at)
            found = found * 2 + bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return found

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        edges = np.array([begin, end], dtype=np.int64)
        if token >> len(self.planes):
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.ones_before(edges)
            edges = zeros + ones if token >> (len(self.planes) - 1 - level) & 1 else edges - ones
        return int(edges[0]), int(edges[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often the token occurs from ``begin`` to ``end``."""
        low, high = self._range(token, begin, self.size if end is None else end)
        return high - low

    def places(self, token: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Where the token occurs from ``begin`` to ``end``, ascending."""
        low, high = self._range(token, begin, self.size if end is None else end)
        at = np.arange(low, high)
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self.planes[level].select(bit, at - self.zeros[level] * bit)
        return at


def to_bytes(matrix: WaveletMatrix, sections: dict[str, np.ndarray]) -> bytes:
    """One file: magic, header length, header, then the compressed planes, rank directories and further sections."""
    parts = [("planes", plane.packed) for plane in matrix.planes] + [("ranks", plane.ranks) for plane in matrix.planes]
    parts += list(sections.items())
    packer = zstandard.ZstdCompressor(level=1)
    bodies = [packer.compress(np.ascontiguousarray(part)) for _, part in parts]
    header = {
        "size": matrix.size,
        "zeros": matrix.zeros,
        "sections": [[name, part.dtype.str, len(body)] for (name, part), body in zip(parts, bodies, strict=True)],
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *bodies])


def from_bytes(content: bytes) -> tuple[WaveletMatrix, dict[str, np.ndarray]]:
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 12 + int.from_bytes(content[8:12], "little")
    header = json.loads(content[12:at])
    unpacker, found, view = zstandard.ZstdDecompressor(), {}, memoryview(content)
    for name, kind, length in header["sections"]:
        found.setdefault(name, []).append(np.frombuffer(unpacker.decompress(view[at : at + length]), dtype=kind))
        at += length
    planes = [Plane(packed, header["size"], ranks) for packed, ranks in zip(found.pop("planes"), found.pop("ranks"), strict=True)]
    return WaveletMatrix(header["size"], planes, header["zeros"]), {name: parts[0] for name, parts in found.items()}
