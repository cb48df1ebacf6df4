"""The adaptive binary arithmetic coder (both directions) and the raw bit reader of code-block segments."""

from __future__ import annotations

#: Fixed values: (probability, next state on the likely symbol, on the unlikely one, whether the likely symbol flips).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
CONTEXTS, RUN, UNIFORM = 19, 17, 18


def fresh() -> list[int]:
    """Contexts at their start, each as 2 * state + likely symbol."""
    out = [0] * CONTEXTS
    out[0], out[RUN], out[UNIFORM] = 8, 6, 92
    return out


class Decoder:
    """Reads decisions from bytes; past the end it sees ones for ever, so damaged data never fails."""

    __slots__ = ("data", "at", "a", "c", "left", "cx")

    def __init__(self, data: bytes, cx: list[int]) -> None:
        self.data, self.at, self.cx = data, 0, cx
        self.c = (data[0] if data else 0xFF) << 16
        self._byte()
        self.c <<= 7
        self.left -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        d, at = self.data, self.at
        now = d[at] if at < len(d) else 0xFF
        nxt = d[at + 1] if at + 1 < len(d) else 0xFF
        if now == 0xFF:
            if nxt > 0x8F:
                self.c += 0xFF00
                self.left = 8
            else:
                self.at = at + 1
                self.c += nxt << 9
                self.left = 7
        else:
            self.at = at + 1
            self.c += nxt << 8
            self.left = 8

    def bit(self, k: int) -> int:
        s = self.cx[k]
        q, likely, unlikely, flip = STATES[s >> 1]
        out = s & 1
        self.a -= q
        if (self.c >> 16) < q:
            if self.a < q:
                self.cx[k] = 2 * likely + out
            else:
                self.cx[k] = 2 * unlikely + (out ^ flip)
                out ^= 1
            self.a = q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return out
            if self.a < q:
                self.cx[k] = 2 * unlikely + (out ^ flip)
                out ^= 1
            else:
                self.cx[k] = 2 * likely + out
        while True:
            if not self.left:
                self._byte()
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
            if self.a & 0x8000:
                return out


class Encoder:
    """Writes decisions; ``end`` gives the finished bytes."""

    def __init__(self, cx: list[int]) -> None:
        self.cx, self.a, self.c, self.left, self.out = cx, 0x8000, 0, 12, bytearray([0])

    def _byte(self) -> None:
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c &= 0xFFFFF
            self.left = 7
            return
        if self.c & 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
            if self.out[-1] == 0xFF:
                self._byte()
                return
        self.out.append(self.c >> 19 & 0xFF)
        self.c &= 0x7FFFF
        self.left = 8

    def bit(self, k: int, value: int) -> None:
        s = self.cx[k]
        q, likely, unlikely, flip = STATES[s >> 1]
        self.a -= q
        if value == s & 1:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
            self.cx[k] = 2 * likely + (s & 1)
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            self.cx[k] = 2 * unlikely + (s & 1 ^ flip)
        while True:
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
            if not self.left:
                self._byte()
            if self.a & 0x8000:
                return

    def end(self) -> bytes:
        full = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= full:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.left
            self._byte()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:])


class Raw:
    """Bits as they are, most significant first, seven of them after a byte FF; ones past the end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.byte, self.left = data, 0, 0, 0

    def bit(self, _: int = 0) -> int:
        if not self.left:
            self.left = 7 if self.byte == 0xFF and self.at else 8
            self.byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.at += 1
        self.left -= 1
        return self.byte >> self.left & 1
