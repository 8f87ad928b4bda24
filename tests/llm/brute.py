"""Plain versions of the operators, for small inputs."""

import math
import re
import string
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    found, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if found[g] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


def shingles(text, k=4):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_components(docs, k=4, num=80):
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = Counter()
    for group in by.values():
        for x in range(len(group)):
            for y in range(x):
                pairs[group[y], group[x]] += 1
    for (i, j), inter in pairs.items():
        if 100 * inter >= num * (len(sets[i][1]) + len(sets[j][1]) - inter):
            a, b = root(sets[i][0]), root(sets[j][0])
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets}


def repeated_passages(docs, width=50):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        cover = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                cover.update(range(i, i + width))
        out.append((d, len(w), len(cover), " ".join(x for i, x in enumerate(w) if i not in cover)))
    return out


def rule_scores(text):
    text = text or ""
    w = words(text)
    n, chars, symbols, dup, repeated = base_counts(text)
    lines = sum(1 for x in text.split("\n") if WORD.search(x))
    upper, punct = sum(c in string.ascii_uppercase for c in text), sum(c in string.punctuation for c in text)
    return {
        "symbols_per_word": symbols / max(n, 1),
        "duplicate_line_share": dup / max(lines, 1),
        "repeated_word_share": repeated / max(n, 1),
        "upper_share": upper / max(chars, 1),
        "punctuation_share": punct / max(chars, 1),
        "top_word_share": max(Counter(w).values()) / n if n >= 20 else 0.0,
    }


def at_most(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def quality_verdicts(rows, known, cutoffs, risk, error):
    """(doc_id, kept, rejected_by) by counting everything in plain loops."""
    scored = []
    for doc, text, lang in rows:
        n, _, _, _, repeated = base_counts(text)
        scored.append((doc, lang or "", n < 20 or 100 * repeated > 30 * n, rule_scores(text)))
    by = defaultdict(lambda: ([], []))
    for doc, lang, failed, scores in scored:
        if not failed and doc in known:
            by[lang][1 - known[doc]].append(scores)
    level = error / (len(cutoffs) * (len(by) + (len(by) > 1)))
    pool = tuple([s for pair in by.values() for s in pair[i]] for i in (0, 1))

    def chosen(good, low, own, rule):
        best, gain = None, 0
        for cut in cutoffs[rule]:
            g, b = (sum(s[rule] > cut for s in part) for part in (good, low))
            refuting = own is not None and sum(s[rule] > cut for s in own)
            if g >= len(good) * risk or at_most(len(good), g, risk) > level or (refuting and 1 - at_most(len(own), refuting - 1, risk) <= level):
                break
            if b - g > gain:
                best, gain = cut, b - g
        return best

    taken = {}
    for lang, (good, low) in by.items():
        enough = good and (1 - risk) ** len(good) <= level
        taken[lang] = {r: chosen(good, low, None, r) if enough else chosen(*pool, good, r) for r in cutoffs}
    out = []
    for doc, lang, failed, scores in scored:
        cuts = taken.get(lang, {})
        reasons = ["base"] * failed + [r for r in cutoffs if cuts.get(r) is not None and scores[r] > cuts[r]]
        out.append((doc, not reasons, ",".join(reasons)))
    return out
