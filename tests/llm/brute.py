"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def jaccard_components(docs: dict, k: int = 4, percent: int = 85) -> dict:
    """id -> (size of the set, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    seen = set()
    for ids in holders.values():
        for a, b in combinations(sorted(ids), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def remove_repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, bytes]]:
    """Per text: bytes, removed bytes, maximal removed runs, kept bytes."""
    raw = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


# --- personal data: the patterns as they are written in the contract ---

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind: str, s: str) -> bool:
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in _BASE.items() for m in re.finditer(p, text or "") if _passes(k, m.group())]


# --- repetition counts ---

def repetition(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": n < 50 or 100 * len(inside) > 50 * n}


def covered_chars(text: str, n: int) -> int:
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - n + 1):
        windows[tuple(words[i:i + n])].append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + n)}
    return sum(len(words[j]) for j in inside)


# --- greedy string tiling, word by word ---

def tiling(a: list, b: list, k: int) -> int:
    """Covered words of a: repeatedly the longest unmarked match of at least k words, first in a, then in b."""
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        ma[i:i + n] = [True] * n
        mb[j:j + n] = [True] * n
        covered += n


def passage_words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower_ascii(text or ""))
