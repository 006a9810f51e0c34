"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from fractions import Fraction

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def base_rules(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vector_links(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    return [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_links(rows, threshold=Fraction(4, 5)):
    sets = [(i, shingles(t)) for i, t in rows]
    out = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and Fraction(len(x & y), len(x | y)) >= threshold:
                out.append((a, b))
    return out


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def best_fit(counts: np.ndarray, size: int) -> dict[tuple, int]:
    """Longest first, each into the fullest open sequence with room; equal sequences are handled together."""
    groups: dict[tuple, int] = {}
    by_room: dict[int, list[tuple]] = {}
    rooms: list[int] = []

    def put(c: tuple, room: int, m: int) -> None:
        if c not in groups:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(c)
            groups[c] = 0
        groups[c] += m

    def pull(c: tuple, room: int, m: int) -> None:
        groups[c] -= m
        if not groups[c]:
            del groups[c]
            by_room[room].remove(c)
            if not by_room[room]:
                del by_room[room]
                rooms.remove(room)

    for ln in range(size, 0, -1):
        n = int(counts[ln])
        while n:
            k = bisect_left(rooms, ln)
            if k == len(rooms):
                each = size // ln
                if n >= each:
                    put(((ln, each),), size - each * ln, n // each)
                if n % each:
                    put(((ln, n % each),), size - n % each * ln, 1)
                break
            room = rooms[k]
            c = by_room[room][0]
            each = min(room // ln, n)
            m = min(groups[c], n // each)
            pull(c, room, m)
            put((*c, (ln, each)), room - each * ln, m)
            n -= m * each
    return groups
