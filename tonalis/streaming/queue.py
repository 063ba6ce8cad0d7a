"""The rules of the job queue, an event at a time.

The same object serves a batch, a stream and a caller that asks it directly.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Seconds after which a job is stale, jobs that may wait at once, and seconds of silence after which the bridge counts as gone.
STALE, MOST, SILENCE = 900.0, 100, 5.0


@dataclass
class Ledger:
    """Jobs in the order in which they were submitted; times are microseconds.

    A job is ``pending``, ``in_progress``, ``done`` or ``failed``.  Stale jobs of
    any status are evicted when another is submitted, and only then: until then a
    poll may still take one.  A job that got its result while it waited keeps its
    place in the queue, and counts as waiting, until a poll passes over it.
    """

    stale: float = STALE
    most: int = MOST
    #: job: [submitted at, status]
    jobs: dict[int, list] = field(default_factory=dict)
    waiting: list[int] = field(default_factory=list)
    last_poll: int | None = None

    def submit(self, job: int, now: int) -> tuple[bool, list[int]]:
        """Whether the job was taken in, and the jobs that were evicted before."""
        gone = [j for j, (at, _) in self.jobs.items() if now - at > self.stale * 1e6]
        for j in gone:
            del self.jobs[j]
        if gone:
            self.waiting = [j for j in self.waiting if j in self.jobs]
        if len(self.waiting) >= self.most:
            return False, gone
        self.jobs[job] = [now, "pending"]
        self.waiting.append(job)
        return True, gone

    def poll(self, now: int) -> int | None:
        """The next pending job, which is in progress from now on; None if there is none."""
        self.last_poll = now
        while self.waiting:
            job = self.waiting.pop(0)
            if job in self.jobs and self.jobs[job][1] == "pending":
                self.jobs[job][1] = "in_progress"
                return job
        return None

    def result(self, job: int, status: str | None) -> str | None:
        """The job's status after its result, done for ``ok`` and failed for all else; None if the job is unknown."""
        if job not in self.jobs:
            return None
        self.jobs[job][1] = "done" if status == "ok" else "failed"
        return self.jobs[job][1]

    def take(self, job: int) -> str | None:
        """What waiting for a job gives: done or failed, upon which the job is forgotten; its other status while there is no result; None if it is unknown."""
        status = self.status(job)
        if status in ("done", "failed"):
            del self.jobs[job]
        return status

    def status(self, job: int) -> str | None:
        """The job's status; None if it is unknown."""
        return self.jobs[job][1] if job in self.jobs else None

    def pending(self) -> int:
        """Jobs that wait."""
        return len(self.waiting)

    def seconds_since_poll(self, now: int) -> float | None:
        """Seconds since the last poll; None if there was none."""
        return None if self.last_poll is None else (now - self.last_poll) / 1e6

    def connected(self, now: int, silence: float = SILENCE) -> bool:
        """Whether the bridge polled of late."""
        since = self.seconds_since_poll(now)
        return since is not None and since <= silence

    def step(self, kind: str, job: int | None, status: str | None, now: int) -> list[tuple[str, int | None, str, int]]:
        """Applies an event; (kind, job, outcome, jobs waiting after it) for it and, before it, for the jobs that it evicted.

        A submitted job is ``pending`` or ``rejected``; a poll takes a job
        (``in_progress``) or is ``empty``; a result makes its job ``done`` or
        ``failed`` or is ``unknown``; a wait tells the job's status, or ``unknown``.
        Other kinds change nothing and are ``ignored``.
        """
        out: list[tuple[str, int | None, str]] = []
        if kind == "submit":
            taken, gone = self.submit(job, now)
            out = [*(("evict", j, "evicted") for j in gone), ("submit", job, "pending" if taken else "rejected")]
        elif kind == "poll":
            found = self.poll(now)
            out = [("poll", found, "empty" if found is None else "in_progress")]
        elif kind == "result":
            out = [("result", job, self.result(job, status) or "unknown")]
        elif kind == "wait":
            out = [("wait", job, self.take(job) or "unknown")]
        else:
            out = [(kind, job, "ignored")]
        return [(*o, self.pending()) for o in out]

    def dump(self) -> str:
        """The state as text."""
        return json.dumps([list(self.jobs.items()), self.waiting, self.last_poll])

    def load(self, text: str) -> None:
        """Takes up what ``dump`` gave."""
        jobs, self.waiting, self.last_poll = json.loads(text)
        self.jobs = {j: v for j, v in jobs}
