"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15),
}


def pii(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in BASE.items()}
    listed = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in found[k])
    return [len(found[k]) for k in BASE], sha(listed), listed


def line_dedup(docs):
    """docs: (doc_id, text); result by place."""
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (-1, 0) if i is None else (0, i)
    holders = defaultdict(set)
    lines = [(t or "").split("\n") for _, t in docs]
    for place, own in enumerate(lines):
        for line in own:
            if len(key(line)) >= 40:
                holders[key(line)].add(place)
    out = []
    for place, own in enumerate(lines):
        kept = []
        for line in own:
            where = holders[key(line)]
            last = max((order(docs[p][0]) for p in where), default=None)
            if not (len(key(line)) >= 40 and len(where) >= 5 and order(docs[place][0]) < last):
                kept.append(line)
        out.append((docs[place][0], len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def low_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = low_words(text)
        for i in range(max(1, len(words) - 12)) if words else []:
            windows[tuple(words[i : i + 13])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = low_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        listed = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), sha(listed), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def statistics(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def crc(data):
    return zlib.crc32(data)


def shingles(text, n=5):
    words = low_words(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
