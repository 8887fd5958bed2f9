"""Which terms of a roster stand in which lines, at any offset. Works on UTF-8 bytes, where a term is in a line exactly if its bytes are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a term's head: the largest that it has. Windows of a line are coded in these widths.
WIDTHS = (1, 2, 4, 8, 16, 32)
#: Bytes of a batch that are coded at once.
SEGMENT = 1 << 20
_FILTER = 1 << 16


def head_width(term: bytes) -> int:
    return max((w for w in WIDTHS if w <= len(term)), default=0)


def _doubled(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes of windows of 2 * width from those of width: exact up to 8 bytes, hashes from there."""
    first, second = codes[:-width], codes[width:]
    if width < 8:
        return first | (second << np.uint64(8 * width))
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_codes(data: np.ndarray, width: int) -> np.ndarray:
    """Code of each window of `width` bytes; equal windows have equal codes."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    codes, w = data.astype(np.uint64), 1
    while w < width:
        codes, w = _doubled(codes, w), 2 * w
    return codes


class Roster:
    """Terms by the code of their head."""

    def __init__(self, terms: list[bytes]):
        self.everywhere = b"" in terms
        self.heads: dict[int, dict[int, list[bytes]]] = {}
        for term in terms:
            if width := head_width(term):
                code = int(window_codes(np.frombuffer(term, np.uint8, width), width)[0])
                self.heads.setdefault(width, {}).setdefault(code, []).append(term)
        self.codes = {w: np.array(sorted(heads), np.uint64) for w, heads in self.heads.items()}
        self.filters = {}
        for w, codes in self.codes.items():
            self.filters[w] = np.zeros(_FILTER, bool)
            self.filters[w][self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def found(self, lines: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Numbers of lines and the terms in them, each term once a line. Lines have no nulls."""
        values = lines.cast(pa.large_binary())
        n = len(values)
        pairs: set[tuple[int, bytes]] = {(i, b"") for i in range(n)} if self.everywhere else set()
        edges = np.frombuffer(values.buffers()[1], np.int64, n + 1, 8 * values.offset) if n else np.zeros(1, np.int64)
        if edges[-1] > edges[0]:
            whole = memoryview(values.buffers()[2]).cast("B")
            for start in range(int(edges[0]), int(edges[-1]), SEGMENT):
                self._segment(whole, start, edges, pairs)
        ordered = sorted(pairs)
        return pa.array([i for i, _ in ordered], pa.int64()), pa.array([t.decode() for _, t in ordered], pa.string())

    def _segment(self, whole: memoryview, start: int, edges: np.ndarray, pairs: set) -> None:
        stop = min(start + SEGMENT, int(edges[-1]))
        data = np.frombuffer(whole, np.uint8, min(stop + WIDTHS[-1] - 1, int(edges[-1])) - start, start)
        codes = data.astype(np.uint64)
        for width in WIDTHS:
            if width > 1:
                if len(codes) <= width // 2:
                    return
                codes = _doubled(codes, width // 2)
            if width not in self.codes:
                continue
            here = codes[: stop - start]
            at = np.flatnonzero(self.filters[width][self._slot(here)])
            known = self.codes[width]
            near = np.searchsorted(known, here[at])
            at = at[known[np.minimum(near, len(known) - 1)] == here[at]]
            line = np.searchsorted(edges, at + start, side="right") - 1
            for place, code, i, end in zip((at + start).tolist(), here[at].tolist(), line.tolist(), edges[line + 1].tolist()):
                for term in self.heads[width][code]:
                    if place + len(term) <= end and whole[place : place + len(term)] == term:
                        pairs.add((i, term))
