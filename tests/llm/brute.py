"""Plain models of the operators, and tables with every odd case."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, value double, fp string, home string, kind string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    data = [(i, t, g, s, None if t is None else len(t), "x", 1.5, "y", "z", "k") for i, t, g, s in rows]
    return spark.createDataFrame(data, SCHEMA)


def _vocabulary():
    rnd = random.Random(0)
    return ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(2 + i % 8)) for i in range(4000)]


VOCABULARY = _vocabulary()


def prose(seed, words=80, alphabet=400):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY[:alphabet]) for _ in range(words))


def odd_rows():
    """Nulls, empty and blank texts, ties, repeats, long texts, odd characters."""
    long = "\n".join(prose(i, 30) for i in range(60))
    return [
        (1, "", "en", "a"),
        (2, None, "en", "a"),
        (3, " \t\n ", None, None),
        (4, "one", "en", "b"),
        (5, "one two", "en", "b"),
        (6, long, "en", "b"),
        (7, long + " tail", "de", "c"),
        (8, prose(1), "en", "c"),
        (8, prose(1), "en", "c"),
        (9, prose(1), None, "d"),
        (None, prose(2), "en", "d"),
        (10, "Straße ÉTÉ 中文 🙂 'S it's <|endoftext|> x\x85y\xa0z \x00 \x1c", "fr", None),
        (11, "a" * 3000, "en", "a"),
        (12, "ab" * 2000, "en", "a"),
        (13, prose(3) + "\n" + prose(4), "en", "e"),
        (14, prose(5) + "\n" + prose(4), "en", "f"),
        (15, prose(4), "en", "g"),
    ]


# ---- near duplicates


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Least id reachable for each (id, fingerprint) over links of two or fewer bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, (name, _) in enumerate(prints):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(prints))]


# ---- spans


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secret_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    tests = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([ -]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in tests for m in re.finditer(p, text) if good(m)]


# ---- repeats


def repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256) per row of (id, text)."""
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        order = -(1 << 63) if i is None else i
        for s in {t[p : p + length] for p in range(len(t) - length + 1)}:
            first[s] = min(first.get(s, order), order)
    out = []
    for i, t in texts:
        order = -(1 << 63) if i is None else i
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < order:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


# ---- quality


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


# ---- search


def best(rows, asked, k):
    """(query, rank, id, score) by BM25 over all rows."""
    docs = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in rows if i is not None]
    mean = max(1.0, sum(sum(c.values()) for _, c in docs) / max(1, len(docs)))
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, text in asked:
        query = Counter(re.findall(r"\w+", (text or "").lower()))
        scored = []
        for i, c in docs:
            size = max(1, sum(c.values()))
            score = sum(
                n * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, n in query.items() if w in c
            )
            if score > 0:
                scored.append((-score, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out
