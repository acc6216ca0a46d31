"""When runs start: a daily digest at a local time, and alert polls between."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from ledeforge.functions import vocabulary as V
from ledeforge.sources.market import Settings


def next_digest(now: datetime, settings: Settings) -> datetime:
    """The first moment after ``now`` at which the clock in the digest's time zone shows its time; a time that the clock skips that day is taken as the zone maps it."""
    zone = ZoneInfo(settings.digest_tz)
    hour, minute = map(int, settings.digest_time.split(":"))
    day = now.astimezone(zone).date()
    while True:
        at = datetime(day.year, day.month, day.day, hour, minute, tzinfo=zone).astimezone(UTC)
        if at > now:
            return at
        day += timedelta(days=1)


def serve(digest: Callable[[datetime], None], alerts: Callable[[datetime], None], settings: Settings, until: datetime | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC), sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs both jobs when they are due, ``until`` a moment or for ever; gives how many ran.

    A job that fails is left to the next time. After a pause, such as a job that
    took long, what was due runs once and not once for every time missed.
    """
    poll = timedelta(minutes=V.ALERT_POLL_MINUTES)
    due = {digest: next_digest(clock(), settings), alerts: clock() + timedelta(minutes=1)}
    ran = 0
    while until is None or min(due.values()) <= until:
        job = min(due, key=due.get)
        if (wait := (due[job] - clock()).total_seconds()) > 0:
            sleep(wait)
        now = clock()
        try:
            job(now)
        except Exception as e:  # the next run must come all the same
            print(f"{now:%Y-%m-%d %H:%M} a run failed: {e}")
        ran += 1
        due[job] = next_digest(clock(), settings) if job is digest else clock() + poll
    return ran
