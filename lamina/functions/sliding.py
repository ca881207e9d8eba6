"""A sliding log of admitted times, shared by the batch and the streaming rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class SlidingLog:
    """Admits at most ``most`` times in any ``window``; only admitted ones are remembered, so it holds ``most`` times."""

    def __init__(self, window: float, most: int, admitted: Iterable[float] = ()):
        self.window, self.most, self.admitted = window, most, deque(admitted, maxlen=max(most, 1))

    def wait(self, now: float) -> int:
        """0 and the time is remembered, or the whole seconds (1 at least) after which to ask again."""
        while self.admitted and now >= self.admitted[0] + self.window:
            self.admitted.popleft()
        if len(self.admitted) < self.most:
            self.admitted.append(now)
            return 0
        opens = self.admitted[0] + self.window if self.admitted else now + self.window
        return max(1, int(opens - now) + 1)
