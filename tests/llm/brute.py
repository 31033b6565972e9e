"""Plain Python versions of the operators' contracts, written from the contracts alone."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def pii(text: str | None) -> dict:
    t = text or ""
    num = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(num(s)) <= 19 and luhn(num(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(num(s)) <= 15),
    }
    spans = {k: [m.span() for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in kinds.items()}
    return {f"n_{k}": len(v) for k, v in spans.items()} | {"base_sha256": sha(",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v))}


def secrets(text: str | None) -> dict:
    t = text or ""
    kinds = {
        "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 32),
    }
    spans = {k: [m.span() for m in re.finditer(p, t) if ok(m)] for k, (p, ok) in kinds.items()}
    order = list(kinds)
    base = sorted((a, order.index(k), b) for k, v in spans.items() for a, b in v)
    return {f"n_{k}": len(v) for k, v in spans.items()} | {"base_sha256": sha(",".join(f"{order[k]}:{a}:{b}" for a, k, b in base))}


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items: dict[int, int]) -> dict[int, int]:
    """id -> smallest id reachable over fingerprints at distance two or less."""
    by_fp: dict[int, list[int]] = {}
    for i, fp in items.items():
        by_fp.setdefault(fp, []).append(i)
    fps, root = list(by_fp), {}
    left = set(fps)
    while left:
        stack, group = [left.pop()], []
        while stack:
            x = stack.pop()
            group.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            stack += near
        least = min(i for f in group for i in by_fp[f])
        root |= {i: least for f in group for i in by_fp[f]}
    return root


def five_words(text: str | None) -> set[str]:
    words = WORD.findall(lower(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(items: dict[int, str | None]) -> dict[int, int]:
    """id -> smallest id reachable over texts whose five-word shingles have a similarity of 0.8 or more."""
    sets, root = {i: five_words(t) for i, t in items.items()}, {}
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    left = set(items)
    while left:
        stack, group = [left.pop()], []
        while stack:
            x = stack.pop()
            group.append(x)
            found = {y for y in left if near(sets[x], sets[y])}
            left -= found
            stack += found
        root |= dict.fromkeys(group, min(group))
    return root


def quality(text: str | None) -> dict:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": n < 50 or 100 * len(hit) > 50 * n,
    }


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs: dict[int, str | None], items: dict[int, str | None]) -> dict[int, dict]:
    windows: dict[tuple, set[int]] = {}
    for i, text in items.items():
        w = item_words(text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, text in docs.items():
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out[d] = {"n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha(",".join(sorted(map(str, found)))), "contaminated": bool(hit)}
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
