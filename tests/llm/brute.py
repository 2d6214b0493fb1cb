"""Plain versions of the text operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept) from all pairs that share a shingle."""
    sets = {}
    for key, text in docs:
        words = SPACE.findall(lower_ascii(text or ""))
        n = len(words)
        sets[key] = {tuple(words[i : i + 5]) for i in range(n - 4)} if n >= 5 else {tuple(words)} if n else set()
    holders: dict[tuple, list[int]] = {}
    for key, shingles in sets.items():
        for s in shingles:
            holders.setdefault(s, []).append(key)
    top = {key: key for key in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    shared: dict[tuple[int, int], int] = {}
    for keys in holders.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    return {key: (len(s), root(key), root(key) == key) for key, s in sets.items()}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], width: int = 8) -> dict[int, tuple]:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict[tuple[str, ...], set[str | None]] = {}
    for name, text in items:
        words = ALNUM.findall(lower_ascii(text or ""))
        for i in range(max(len(words) - width, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(None if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = {}
    for key, text in docs:
        words = ALNUM.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners:
                    hit |= set(range(i, i + n))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest()
        out[key] = (len(words), len(hit), len(found), digest, len(found) >= 2)
    return out


def personal(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) with the contract's own patterns."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s: str) -> bool:
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(s))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [
        (m.start(), order, kind, m.end())
        for order, (kind, (pattern, good)) in enumerate(kinds.items())
        for m in re.finditer(pattern, text)
        if good(m.group())
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def token_rows(docs: list[tuple[int, str | None]], tokenizer, end_id: int = 1) -> dict[int, tuple[int, int, int]]:
    """doc_id -> (start, n_tokens, ids_crc32) in ascending order of ids."""
    out, start = {}, 0
    for key, text in sorted(docs, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[key] = (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
    return out


