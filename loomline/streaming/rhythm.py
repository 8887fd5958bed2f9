"""The speaker expected next, for one history at a time: what operators.memory.next_expected gives, in plain Python for stateful streams."""

from __future__ import annotations

from ..operators.memory import RHYTHM_LEAST, RHYTHM_ROUNDS, RHYTHM_SHARE


def expected_next(seen: list[str]) -> str | None:
    frame = seen[-RHYTHM_ROUNDS:]
    voices = list(dict.fromkeys(frame))
    if len(frame) >= RHYTHM_LEAST and len(voices) > 1:
        pair, steps = voices[:2], 0
        for voice in frame:
            steps += voice == pair[steps % 2]
        if steps >= RHYTHM_SHARE * len(frame) and all(frame.count(v) >= 2 for v in pair):
            return pair[1] if frame[-1] == pair[0] else pair[0]
    return seen[-2] if len(seen) > 1 and seen[-1] != seen[-2] else None
