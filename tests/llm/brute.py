"""Plain forms of the operators, one text at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(t: str) -> str:
    return t.translate({i: i + 32 for i in range(0x41, 0x5B)})


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def shingles(t: str | None, k: int = 5) -> set:
    w = words(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def classes(rows: list[tuple]) -> dict:
    """id -> smallest id reached by links of at least 0.8."""
    of = {i: i for i, _ in rows if i is not None}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                of[max(p, q)] = min(p, q)
    return {i: root(i) for i in of}


def deduplicated(rows: list[tuple], k: int = 13) -> list[tuple]:
    """(id, n_words, kept words) in the order of rows."""
    least: dict = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and least[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        out.append((i, len(w), [x for p, x in enumerate(w) if p not in gone]))
    return out


def contaminated(rows: list[tuple], items: list[tuple], k: int = 13) -> list[tuple]:
    """(id, n_words, n_hit, item ids, contaminated)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    held = defaultdict(set)
    for item, t in items:
        w = cut(t)
        for p in range(max(1, len(w) - k + 1)) if w else ():
            held[tuple(w[p : p + k])].add(item)
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(g) for g in held}:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in held:
                    hit.update(range(p, p + n))
                    found |= held[g]
        found = sorted(x for x in found if x is not None)
        out.append((i, len(w), len(hit), found, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def symbols(t: str | None) -> list[int]:
    return [*(t or "").encode(), 0xFF]


def levels(texts: list[str | None], order: int) -> list[Counter]:
    """Counts of k + 1 symbols for k up to order; below the longest, of the distinct symbols that come before."""
    top: Counter = Counter()
    for t in texts:
        s = [0xFE] * order + symbols(t)
        top.update(tuple(s[i : i + order + 1]) for i in range(len(s) - order))
    out = [top]
    for _ in range(order):
        out.insert(0, Counter(g[1:] for g in out[0]))
    return out


def ppm_score(t: str | None, counts: list[Counter], order: int) -> float:
    by_context = [defaultdict(dict) for _ in counts]
    for k, c in enumerate(counts):
        for g, n in c.items():
            by_context[k][g[:-1]][g[-1]] = n
    s, total = [0xFE] * order + symbols(t), 0.0
    for i in range(order, len(s)):
        excluded: set = set()
        for k in range(order, -1, -1):
            seen = by_context[k].get(tuple(s[i - k : i]), {})
            here = {x: n for x, n in seen.items() if x not in excluded}
            mass = sum(here.values())
            if s[i] in here:
                total += math.log10((2 * here[s[i]] - 1) / (2 * mass))
                break
            if here:
                total += math.log10(len(here) / (2 * mass))
            excluded |= set(seen)
        else:
            total -= math.log10(255 - len(excluded))
    return total


def kneser_ney(t: str | None, counts: list[Counter], order: int) -> float:
    cuts, by_context = [], []
    for c in counts:
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        cuts.append([min(max(i - (i + 1) * y * b / a, 0.1 * i), 0.9 * i) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
        own = defaultdict(dict)
        for g, n in c.items():
            own[g[:-1]][g[-1]] = n
        by_context.append(own)

    def p(k: int, context: tuple, x: int) -> float:
        lower_p = p(k - 1, context[1:], x) if k else 1 / 256
        seen = by_context[k].get(context, {})
        if not seen:
            return lower_p
        cut = lambda n: cuts[k][min(n, 3) - 1] if n else 0.0
        n = seen.get(x, 0)
        return (n - cut(n) + sum(map(cut, seen.values())) * lower_p) / sum(seen.values())

    s = [0xFE] * order + symbols(t)
    return sum(math.log10(p(order, tuple(s[i - order : i]), s[i])) for i in range(order, len(s)))
