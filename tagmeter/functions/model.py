"""The bounded store as a sequential model: watermark, rings, eviction.

The streaming state processor runs it; tests use it as the reference for the
set-based operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..plans.sizing import evict_live, evict_target

DECAY = 0.99


@dataclass
class Entry:
    seq: int
    stats_since: int
    last_bucket: int
    usage: float = 1.0
    calls_total: int = 0
    exec_time_total: float = 0.0
    slots: dict[int, list] = field(default_factory=dict)  # bucket: [calls, ms]
    exemplars: dict[str, str] = field(default_factory=dict)


class BoundedStore:
    def __init__(self, max_entries: int, bucket_count: int) -> None:
        self.max_entries, self.bucket_count = max_entries, bucket_count
        self.entries: dict[tuple, Entry] = {}
        self.current: int | None = None
        self.made = 0
        self.counters = {"dealloc": 0, "reclaimed_entries": 0, "evicted_entries": 0, "dropped_records": 0}

    def advance(self, bucket: int) -> int:
        """The watermark never falls; readers advance it too."""
        self.current = bucket if self.current is None else max(self.current, bucket)
        return self.current

    def dead(self, e: Entry) -> bool:
        return e.last_bucket < self.current - self.bucket_count + 1

    def reclaim(self) -> int:
        """Free dead entries, without decay or eviction."""
        gone = [k for k, e in self.entries.items() if self.dead(e)]
        for k in gone:
            del self.entries[k]
        self.counters["reclaimed_entries"] += len(gone)
        return len(gone)

    def evict(self) -> None:
        freed = self.reclaim()
        k = evict_live(evict_target(self.max_entries), freed, len(self.entries))
        order = sorted(self.entries.items(), key=lambda t: (t[1].last_bucket, t[1].usage, t[1].seq))
        for key, _ in order[:k]:
            del self.entries[key]
        self.counters["evicted_entries"] += k
        self.counters["dealloc"] += 1
        for e in self.entries.values():
            e.usage *= DECAY

    def record(self, key: tuple, bucket: int, ms: float, at: int = 0, exemplars: dict[str, str] | None = None) -> None:
        bucket = self.advance(bucket)  # late buckets are raised, never dropped
        e = self.entries.get(key)
        if e is None:
            if len(self.entries) >= self.max_entries:
                self.evict()
                if len(self.entries) >= self.max_entries:
                    self.counters["dropped_records"] += 1
                    return
            self.made += 1
            e = self.entries[key] = Entry(self.made, at, bucket)
        else:
            e.usage += 1
        e.last_bucket = max(e.last_bucket, bucket)
        slot = e.slots.setdefault(bucket, [0, 0.0])
        slot[0] += 1
        slot[1] += ms
        e.calls_total += 1
        e.exec_time_total += ms
        e.exemplars.update(exemplars or {})
        for b in [b for b in e.slots if b < bucket - self.bucket_count + 1]:
            del e.slots[b]

    def rows(self, bucket: int | None = None) -> list[tuple]:
        """(key, bucket, calls, ms, calls_total, exec_time_total) of live slots."""
        if bucket is not None:
            self.advance(bucket)
        low = (self.current or 0) - self.bucket_count + 1
        return [(k, b, c, ms, e.calls_total, e.exec_time_total) for k, e in self.entries.items() for b, (c, ms) in sorted(e.slots.items()) if b >= low]

    def closed(self) -> list[tuple]:
        return [r for r in self.rows() if r[1] == self.current - 1]

    def reset(self) -> None:
        """Entries and counters go; the watermark stays."""
        self.entries.clear()
        self.counters = dict.fromkeys(self.counters, 0)
