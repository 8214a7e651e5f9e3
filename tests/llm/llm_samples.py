"""Small documents with every awkward case, and brute-force groups."""

import random
import re
from collections import defaultdict

EMPTY = "doc_id long, text string, id long, n long, words string, step int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _docs():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéino") for _ in range(rng.randrange(2, 6)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "Two words", "...\n---\n***\n---", *base]
    for b in base[:12]:
        ws = b.split(" ")
        ws[len(ws) // 2] = "Changed"
        texts += [b, b.upper() if b.isascii() else b, " ".join(ws)]
    shared = "first shared line here\nsecond shared line\r\nthird shared line"
    texts += [f"{base[20]}\n{shared}\n{base[21]}", f"{shared}\n{shared}\nend of it", f"{base[22]}\n{shared}", shared, "the " * 400 + base[5]]
    rows = [(i, t, 1, 2, "w", 3) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[1], (None, base[3], 1, 2, "w", 3)]


DOCS = _docs()


def brute_groups(rows, threshold, width):
    sets, holders = {}, defaultdict(list)
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        for x in sets[i]:
            holders[x].append(i)
    common, group = defaultdict(int), {i: i for i in sets}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= round(100 * threshold) * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            group[max(a, b)] = min(a, b)
    return {i: len(s) for i, s in sets.items()}, {i: root(i) for i in sets}
