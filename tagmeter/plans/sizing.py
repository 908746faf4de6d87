"""Integer arithmetic of memory layout (E17, E18) and eviction."""

from __future__ import annotations


def align8(n: int) -> int:
    return (n + 7) // 8 * 8


def exemplar_layout(max_entries: int, memory: int, keys: int) -> tuple[int, int]:
    """(bytes of a value, bytes of an entry's block); (0, 0) without room."""
    if not keys:
        return 0, 0
    block = memory // max_entries // 8 * 8
    value = min(block // keys - 2, 256)
    return (value, block) if value > 0 else (0, 0)


def evict_target(max_entries: int) -> int:
    """Entries that one pass should free: 5 %, one at least."""
    return max(1, max_entries * 5 // 100)


def evict_live(target: int, dead: int, live: int) -> int:
    return max(0, min(target - dead, live))


def pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def exemplar_bytes(max_entries: int, memory: int, keys: int) -> int:
    value, _ = exemplar_layout(max_entries, memory, keys)
    return align8(keys * (2 + value)) if value > 0 else 0


def store_bytes(max_entries: int, max_tagset_bytes: int, bucket_count: int, exemplar: int = 0) -> int:
    """Bytes of the fixed-size store: entries with their rings, in groups, and
    the hash directory over them."""
    element = align8(24 + max_tagset_bytes) + 48 + 24 * bucket_count + exemplar + 16
    chunk = 256
    while chunk // element < 32:
        chunk *= 2
    group = chunk // element
    segments = max(1, pow2(max_entries) // 256)
    groups = -(-max_entries // group)
    return align8(240 + 24 * max_entries) + 848 + 8 * max(256, segments) + 2048 * segments + groups * group * element


def cap_bytes(slots: int) -> int:
    return 32 + 8 * (slots + 2 * max(64, slots // 16))


def max_backends(server_major: int = 18, connections: int = 100, autovacuum: int | None = None, workers: int = 8, senders: int = 10) -> int:
    """From 18 on autovacuum slots (16) count instead of workers (3); 17 has
    one more process than 14 to 16."""
    auto = autovacuum if autovacuum is not None else (16 if server_major >= 18 else 3)
    return connections + auto + workers + senders + (2 if server_major >= 17 else 1)


def activity_bytes(backends: int, max_tagset_bytes: int) -> int:
    return 16 + backends * align8(36 + max_tagset_bytes)
