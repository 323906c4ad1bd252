"""Identities of structures between sessions: one fold, used by the batch, by the stream and by the snapshot scan.

A ``Tracker`` is the memory of one series.  Fed with each session's sightings and close, it moves known identities along the
legal edges and returns the steps.  A sighting that would need another edge ends the identity and starts a new one; one whose
identity has ended starts a new life; both have the session in their key.  An identity that is not sighted is resolved from
its stored levels, invalidation first; otherwise an unresolved one is lost after ``GRACE`` sessions, and one that has broken
out is carried for ``CARRY``.  Sessions between two dates count as five for every seven days.

A series that is silent for more than ``SILENCE`` days is over: its identities expire on the day on which their grace or carry
ran out, and what comes later starts with an empty memory.  Ended identities are remembered for ``MEMORY`` days after their
structure's start; a structure that is first sighted later than that, or that began before the memory did, has the session in
its key anyway, so keys never repeat.
That, and the number of structures alive at once, bounds a tracker's memory however long a series goes on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

#: Legal edges of a tracked structure.  Terminal states have none.
EDGES = {
    "FORMING": ("MATURE", "NEAR_BREAKOUT", "BROKEN_OUT_UNCONFIRMED", "INVALIDATED", "EXPIRED"),
    "MATURE": ("NEAR_BREAKOUT", "BROKEN_OUT_UNCONFIRMED", "INVALIDATED", "EXPIRED"),
    "NEAR_BREAKOUT": ("MATURE", "BROKEN_OUT_UNCONFIRMED", "INVALIDATED", "EXPIRED"),
    "BROKEN_OUT_UNCONFIRMED": ("INVALIDATED", "EXPIRED"),
}
TERMINAL = ("INVALIDATED", "EXPIRED")
#: States that a family never takes: the level of a retest has been crossed before.
NEVER = {"breakout_retest": ("NEAR_BREAKOUT",)}
GRACE, CARRY = 3, 10
SILENCE = 31
MEMORY = 730
ZERO = dt.date(1970, 1, 1)


class Sighting(NamedTuple):
    base: str
    family: str
    state: str
    quality: float
    level: float
    floor: float
    start: int
    touches: int = 1
    confidence: float = 50.0


class Step(NamedTuple):
    key: str
    family: str
    day: int
    was: str | None
    to: str
    reason: str
    quality: float


@dataclass
class Life:
    key: str
    sighting: Sighting
    state: str
    seen: int

    @property
    def patience(self) -> int:
        return CARRY if self.state == "BROKEN_OUT_UNCONFIRMED" else GRACE

    def due(self) -> int:
        """First day on which its grace or carry has run out."""
        return self.seen + -(-(self.patience + 1) * 7 // 5)


def iso(day: int) -> str:
    return (ZERO + dt.timedelta(days=day)).isoformat()


def legal(family: str, was: str, to: str) -> bool:
    return to == was and to not in TERMINAL or (to in EDGES[was] and to not in NEVER.get(family, ()))


@dataclass
class Tracker:
    lives: dict[str, Life] = field(default_factory=dict)  # by the key that a scan gives the structure
    ended: dict[str, int] = field(default_factory=dict)  # such a key to its structure's start
    last: int | None = None
    since: int | None = None  # first day of this memory

    def observe(self, day: int, close: float | None, sightings: Iterable[Sighting]) -> list[Step]:
        """Steps of one session; days must come in ascending order.  A session without a close ages what isn't sighted."""
        out: list[Step] = []
        if self.last is not None and day - self.last > SILENCE:
            out += self.finish()
        self.last, self.since = day, day if self.since is None else self.since
        lives, ended = self.lives, self.ended
        for s in sightings:
            life = lives.get(s.base)
            if life is not None and s.state != life.state and not legal(s.family, life.state, s.state):
                self._step(out, life, day, "EXPIRED", "superseded")
                life, ended = None, self.ended
            if life is None:
                if s.base in ended and s.state in TERMINAL:
                    continue
                again = s.base in ended or day - s.start > MEMORY or s.start < self.since
                life = lives[s.base] = Life(f"{s.base}:{iso(day)}" if again else s.base, s, s.state, day)
                out.append(Step(life.key, s.family, day, None, s.state, "detected", s.quality))
                if s.state in TERMINAL:
                    self._end(life)
                    ended = self.ended
            else:
                life.sighting, life.seen = s, day
                if s.state != life.state:
                    self._step(out, life, day, s.state, "advanced")
                    ended = self.ended
        for life in [x for x in lives.values() if x.seen != day]:
            self._age(out, life, day, close)
        return out

    def _age(self, out: list[Step], life: Life, day: int, close: float | None) -> None:
        if close is not None and close < life.sighting.floor:
            self._step(out, life, day, "INVALIDATED", "support_broken")
        elif close is not None and close > life.sighting.level and life.state != "BROKEN_OUT_UNCONFIRMED":
            self._step(out, life, day, "BROKEN_OUT_UNCONFIRMED", "carried_forward")
            life.seen = day
        elif (day - life.seen) * 5 // 7 > life.patience:
            self._step(out, life, day, "EXPIRED", "timed_out" if life.state == "BROKEN_OUT_UNCONFIRMED" else "lost")

    def _step(self, out: list[Step], life: Life, day: int, to: str, reason: str) -> None:
        out.append(Step(life.key, life.sighting.family, day, life.state, to, reason, life.sighting.quality))
        life.state = to
        if to in TERMINAL:
            self._end(life)

    def _end(self, life: Life) -> None:
        self.ended[life.sighting.base] = life.sighting.start
        del self.lives[life.sighting.base]
        if len(self.ended) % 64 == 0:
            self.ended = {b: start for b, start in self.ended.items() if self.last - start <= MEMORY}

    def finish(self) -> list[Step]:
        """The series has fallen silent: what lives expires on its due day, and the memory is emptied."""
        out: list[Step] = []
        for life in sorted(self.lives.values(), key=lambda x: (x.due(), x.key)):
            self._step(out, life, life.due(), "EXPIRED", "timed_out" if life.state == "BROKEN_OUT_UNCONFIRMED" else "lost")
        self.lives, self.ended, self.last, self.since = {}, {}, None, None
        return out

    def over(self) -> int | None:
        """The first day on which the series counts as silent."""
        return None if self.last is None else self.last + SILENCE + 1
