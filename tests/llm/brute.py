"""Plain Python versions of what the operators compute, for small tables."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingle_counts(text, k=5):
    w = words(text)
    return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else collections.Counter([tuple(w)] if w else [])


def near_duplicate_classes(texts, share=0.8, frequent=0.01, least=0.7):
    """Class number of each text: components of the weighted Jaccard similarity, equal texts together."""
    sets = [shingle_counts(t) for t in texts]
    df = collections.Counter(s for c in sets for s in c)
    n = len(texts)
    idf = {s: least + (1 - least) * math.log(n / d) / math.log(1 / frequent) if d >= frequent * n else 1.0 for s, d in df.items()}
    weights = [{s: c * idf[s] for s, c in x.items()} for x in sets]
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if not same and weights[i] and weights[j]:
                low = sum(min(w, weights[j][s]) for s, w in weights[i].items() if s in weights[j])
                same = low >= share * (sum(weights[i].values()) + sum(weights[j].values()) - low)
            if same:
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def quality_counts(text):
    w = words(text, lower=False)
    runs = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def base_failed(text):
    n, _, _, _, repeated = quality_counts(text)
    return n < 10 or 100 * repeated > 20 * n
