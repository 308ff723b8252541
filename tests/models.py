"""One-by-one models of the set-wise algorithms; used by the tests only."""

import math
import re
from collections import Counter

from trendloom.functions.lexicon import ENGLISH_STOP_WORDS


def jaccard_at_least(a: set, b: set, percent: int = 55) -> bool:
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def keep_first(sets, held=(), percent=55):
    """Indices kept in arrival order."""
    kept = []
    for i, s in enumerate(sets):
        if not any(jaccard_at_least(s, k, percent) for k in [*held, *[sets[j] for j in kept]]):
            kept.append(i)
    return kept


def unit_vector(text: str) -> dict:
    counts = Counter(w for w in re.findall(r"\w{2,}", text.lower()) if w not in ENGLISH_STOP_WORDS)
    length = math.sqrt(sum(c * c for c in counts.values()))
    return {t: c / length for t, c in counts.items()}


def distance(a: dict, b: dict) -> float:
    la, lb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
    return 1.0 if not la or not lb else round(1 - sum(x * b.get(t, 0) for t, x in a.items()) / la / lb, 9)


def online_clusters(texts, batch_size=1, max_distance=0.6):
    """Cluster number of each text; centroids are frozen within a batch."""
    sums, assigned = {}, []
    vectors = [unit_vector(t) for t in texts]
    for start in range(0, len(texts), batch_size):
        batch = range(start, min(start + batch_size, len(texts)))
        chosen, leaders = {}, []
        for i in batch:
            options = [(distance(vectors[i], s), c) for c, s in sums.items()]
            if options and min(options)[0] < max_distance:
                chosen[i] = min(options)[1]
        for i in batch:
            if i in chosen:
                continue
            options = [(distance(vectors[i], vectors[j]), j) for j in leaders]
            if options and min(options)[0] < max_distance:
                chosen[i] = chosen[min(options)[1]]
            else:
                leaders.append(i)
                chosen[i] = len(sums) + len(leaders)
        for i in batch:
            target = sums.setdefault(chosen[i], {})
            for t, x in vectors[i].items():
                target[t] = target.get(t, 0) + x
            assigned.append(chosen[i])
    return assigned


def sentence_scores(sentences, rounds=20, damping=0.85):
    """PageRank over explicit sentence pairs, scaled to mean 1."""
    vectors, n = [unit_vector(s) for s in sentences], len(sentences)
    df = Counter(t for v in vectors for t in v)
    weighted = [{t: x * math.log(n / df[t]) for t, x in v.items() if 1 < df[t] < n} for v in vectors]
    ties = [[0.0 if i == j else sum(x * b.get(t, 0) for t, x in a.items()) for j, b in enumerate(weighted)]
            for i, a in enumerate(weighted)]
    degree = [sum(row) for row in ties]
    score = [1.0] * n
    for _ in range(rounds):
        lost = sum(s for s, d in zip(score, degree) if d == 0)
        score = [1 - damping + damping * (lost / n + sum(ties[i][j] * score[j] / degree[j] for j in range(n) if degree[j]))
                 for i in range(n)]
    return score
