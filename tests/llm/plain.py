"""Plain versions of operators, for comparison."""

import math
import re
from collections import Counter, defaultdict

KINDS = ("email", "ip", "card", "phone", "term")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS[:4]) for m in re.finditer(BASE[kind], text or "") if holds(kind, m[0])]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def shingles(text, n=5):
    words = [w for w in re.split(r"[\s\x0b\x1c-\x1f\x85\xa0 - 　]+", (text or "").lower()) if w]
    size = min(n, len(words))
    return tuple(words), frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def near_duplicates(rows, threshold=0.8):
    """Per row: smallest id of its group, links of its text, copies."""
    ids, sets = defaultdict(list), {}
    for i, (doc, text) in enumerate(rows):
        words, grams = shingles(text)
        ids[words].append((i, doc))
        sets[words] = grams
    texts, holders, group = list(sets), defaultdict(list), {}
    links = Counter()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, words in enumerate(texts):
        shared = Counter(b for g in sets[words] for b in holders[g])
        for g in sets[words]:
            holders[g].append(a)
        for b, n in shared.items():
            if n / (len(sets[words]) + len(sets[texts[b]]) - n) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    for a, words in enumerate(texts):
        group.setdefault(find(a), []).extend(d for _, d in ids[words] if d is not None)
    return sorted(((doc, min(group[find(a)], default=None), links[a], len(ids[words])) for a, words in enumerate(texts) for _, doc in ids[words]), key=repr)


def best_fit(lengths, capacity):
    """Rooms left after best-fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


TERM = re.compile(r"[^\W\d_][\w'-]{2,}")


def pool(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        return value[value.index("@") :]
    if kind == "ip":
        return value[: value.rindex(".") + 1]
    return digits[:6] + "*" if kind == "card" else "+" + digits[:-4] + "*"


def near_terms(text, start, stop, window=64):
    """Whole words on the span's line that lie within the window."""
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
    line, rest = text[low:start], text[stop : high if high >= 0 else len(text)]
    # Words beside a span are looked for on either side of it by itself.
    left = [m[0].lower() for m in TERM.finditer(line) if low + m.start() >= start - window]
    return left + [m[0].lower() for m in TERM.finditer(rest) if m.end() <= window]


def disclosing(texts, window=64, disclosure=0.8, chance=0.01):
    """Pairs (entity, term) in which the term discloses the entity: mutual
    information over information content, and Chernoff's bound on chance."""
    e_rows, e_contexts, p_rows, p_contexts, df = (defaultdict(set) for _ in range(5))
    for row, text in enumerate(texts):
        for term in {m[0] for m in TERM.finditer(text.lower())}:
            df[term].add(row)
        for span in base_spans(text):
            kind, a, b = span.split(":")
            value, near = text[int(a) : int(b)].lower(), near_terms(text, int(a), int(b), window)
            for entity in (value, pool(kind, value)):
                e_rows[entity].add(row)
                e_contexts[entity].add(tuple(near))
                for term in near:
                    p_rows[entity, term].add(row)
                    p_contexts[entity, term].add(tuple(near))
    sizes = Counter(len(rows).bit_length() for rows in df.values())
    found = set()
    for (entity, term), rows in p_rows.items():
        c, x = min(len(e_contexts[entity]), len(e_rows[entity])), min(len(p_contexts[entity, term]), len(rows))
        total = len(texts) - (len(e_rows[entity]) - c)
        n = len(df[term]) - (len(rows) - x)
        p = c / total
        if p >= 1 or x <= n * p:
            continue
        ic, pmi = -math.log(p), math.log(x / ((n + 1) * p))
        tried = max(1, sum(sizes[k] for k in range(x.bit_length(), n.bit_length() + 1)))
        missed = (n - x) * math.log((1 - p) * n / (n - x)) if n > x else 0
        if pmi >= disclosure * ic and x * math.log(p * n / x) + missed + math.log(tried) <= math.log(chance):
            found.add((entity, term))
    return found
