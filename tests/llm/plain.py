"""Plain versions of the operators' contracts, for tests."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """Per row: set size and the smallest id reachable by links (None counts as the largest)."""
    sets, parent, index = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        shared = Counter(o for x in s for o in index[x])
        for x in s:
            index[x].append(k)
        for o, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                parent[root(k)] = root(o)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(root(k), []).append(i)
    best = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return [(i, len(sets[k]), best[root(k)]) for k, (i, _) in enumerate(rows)]


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for kind, pattern, ok in (
        (0, EMAIL, lambda m: True), (1, IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        (2, CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), (3, PHONE, lambda m: 10 <= len(digits(m)) <= 15),
    ):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out)


def dedup_lines(rows):
    """Texts after removal, in the order of (id, position), for rows with distinct ids."""
    firsts, kept = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n")
        counted = [k for k, line in enumerate(lines) if WORD.search(line)]
        width, gone = min(3, len(counted)), set()
        for p in range(len(counted) - width + 1 if counted else 0):
            at = counted[p : p + width]
            if firsts.setdefault(tuple(lines[k] for k in at), (i, p)) != (i, p):
                gone |= set(at)
        kept[i] = None if text is None else "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return kept


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def licenses(text, phrases):
    """n_words, places, first and last of them, labels of the bare phrases."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = sorted((i, label) for p, label in phrases.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def variants(rows):
    """(word, n, n_near, form, form_n, root) over the texts of (id, text)."""
    c, patterns, near = Counter(), defaultdict(set), defaultdict(set)
    for i, text in rows:
        for w in map(lower, re.findall("[A-Za-z\u00C0-\u00FF]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in c.items() if len(w) >= 5 and k >= 3}
    for w in n:
        for k in range(len(w) + 1):
            patterns[f"{w[:k]}*{w[k:]}"].add(w)
            patterns[f"{w[:k]}*{w[k + 1:]}"].add(w)
    for same in patterns.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n]


def collocations(rows, least=10, share=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) over (lang, text)."""
    f, total, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = defaultdict(int)
    for p, a in found.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                inside[q] = max(inside[q], a)
    by_lang = defaultdict(list)
    for p, a in found.items():
        lang, *w = p
        if not 100 * inside[p] >= share * a or p not in inside:
            cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(w).encode(), left, right))
    for lang, phrases in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out
