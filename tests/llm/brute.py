"""Plain-Python versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows: list[tuple]) -> dict[int, tuple[str, int]]:
    """doc_id -> (fingerprint, smallest id reachable), for distinct ids."""
    fps: dict[int, list[int]] = {}
    for doc, text in rows:
        fps.setdefault(fingerprint(text), []).append(doc)
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[top(a)] = top(b)
    least: dict[int, int] = {}
    for f, docs in fps.items():
        least[top(f)] = min(least.get(top(f), min(docs)), min(docs))
    return {d: (f"{f:016x}", least[top(f)]) for f, docs in fps.items() for d in docs}


def cut(rows: list[tuple], size: int = 35) -> list[tuple]:
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def token_rows(rows: list[tuple], path: str) -> list[tuple]:
    """In the order of ids, which must be distinct."""
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(path), [], 0
    for d, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = re.compile(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(*m.span(), 0) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, ("assign", "access", "hex")[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def leaks(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id) with 13 aligned words (or all of a shorter item) that agree in four of five or more; in all below nine words."""

    def low(t):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    first: dict[tuple, int] = {}
    for i, t in items:
        w = tuple(low(t))
        first[w] = min(first.get(w, i), i)
    out = set()
    for d, t in docs:
        ours = low(t)
        for theirs, item in first.items():
            if not theirs:
                continue
            size = min(13, len(theirs))
            least = size if size < 9 else 0.8 * size
            for shift in range(-len(theirs) + size, len(ours) - size + 1):
                begin = max(shift, 0)
                n = min(shift + len(theirs), len(ours)) - begin
                same = [ours[begin + k] == theirs[begin - shift + k] for k in range(n)]
                if any(sum(same[k : k + size]) >= least for k in range(n - size + 1)):
                    out.add((d, item))
                    break
    return out


def url_parts(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def url_rule(host: str, path: str) -> tuple[str | None, str | None]:
    rules = {
        "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
    }
    fit = []
    for rule in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fit.append(rule)
    best = max(fit, key=len, default=None)
    return best, rules.get(best)


def planted(doc: int, words: list[str]) -> list[str]:
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def lyndon(codes: list) -> list[int]:
    out = []
    for i in range(len(codes)):
        j = i + 1
        while j < len(codes) and codes[j:] > codes[i:]:
            j += 1
        out.append(j - i)
    return out


def word_runs(w: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by trying every period."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(least, 2 * q) and not any(all(w[x] == w[x + r] for x in range(i, end - r)) for r in range(1, q)):
                out.append((i, end - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc: int | None, words: list[str]) -> tuple:
    found = word_runs(words)
    best = (None,) * 4
    if found:
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    gone = {x for s, n, q in found for x in range(s + q, s + n)}
    left = " ".join(x for k, x in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def search(docs: list[tuple], items: list[tuple], most: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score), scoring every document; null ids last."""

    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    held = [(d, w) for d, t in docs if (w := terms(t))]
    many, length = len(held), sum(len(w) for _, w in held)
    counts = [(d, len(w), Counter(w)) for d, w in held]
    out = []
    for item, text in items:
        scores = []
        weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * sum(t in c for _, _, c in counts) + 1))) for t in set(terms(text))}
        for d, n, c in counts:
            m = 100 - 90 + 90 * n * many // length
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:most])]
    return out
