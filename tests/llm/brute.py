"""Plain Python forms of the contracts, one document or all pairs at a time."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if lower else text)


def near_duplicates(rows):
    """``[(doc_id, n_shingles, component_id, kept)]`` of rows ``(doc_id, text)``."""
    sets = []
    for _, text in rows:
        w = words(text, lower=True)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(x)] = min(i, ids.get(find(x), i))
    out = []
    for x, (i, _) in enumerate(rows):
        c = ids.get(find(x)) if sets[x] else i
        out.append((i, len(sets[x]), c, i == c))
    return out


def overlaps(docs, items, window=13, least=11):
    """``{(doc_id, item_id, matched, compared)}`` by the rule alone: every window against every window."""
    out = set()
    for d, dw in docs:
        for i, iw in items:
            m = min(window, len(iw))
            best = max((sum(x == y for x, y in zip(dw[a:a + m], iw[b:b + m]))
                        for a in range(len(dw) - m + 1) for b in range(len(iw) - m + 1)), default=0)
            if m and best * window >= m * least:
                out.add((d, i, best, m))
    return out


def without_repeats(rows, window=35):
    """``[(doc_id, n_words, n_removed, kept_sha256)]``."""
    all_words = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, all_words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def base_rules(text):
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)``."""
    text = text or ""
    w = words(text)
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    keep = {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }
    return [(k, s, e) for k, spans in keep.items() for s, e in spans]


def unigram_scores(rows, held_out):
    """``[(n_tokens, n_known, train_tokens, base_score)]`` by the smoothed unigram model."""
    texts = [words(t, lower=True) + [None] for _, t in rows]
    c = Counter(w for t, h in zip(texts, held_out) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(w in c for w in t), n, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for t in texts]
