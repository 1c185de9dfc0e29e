"""How well bands of perplexity find texts that repeat themselves: python -m tests.llm.study_perplexity FOLDER

A modified Kneser-Ney trigram model of all spoken words of a folder of test tables, in one process. It is no test; it gives
the figures in the README behind the choice of another method for problem 6.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from vocspan.llm import repetition


def discounts(counts: Counter) -> list[float]:
    n = Counter(v for v in counts.values() if v <= 4)
    y = n[1] / max(1, n[1] + 2 * n[2])
    return [0.0] + [k - (k + 1) * y * n[k + 1] / max(1, n[k]) for k in (1, 2, 3)]


def main(folder: str) -> None:
    texts = [t for name, column in (("ycsep_static", "text"), ("tdk_subset", "generated_text")) for t in pq.read_table(f"{folder}/{name}.parquet", columns=[column])[column].to_pylist() if t]
    words = [["<s>", "<s>", *repetition.words_of(t)] for t in texts]
    counts = [Counter(), Counter(), Counter(), Counter(g for w in words for g in zip(w, w[1:], w[2:]))]
    for k in (3, 2):
        counts[k - 1] = Counter(g[1:] for g in counts[k])
    discount = [[]] + [discounts(counts[k]) for k in (1, 2, 3)]
    context: list[dict] = [{} for _ in range(4)]
    for k in (1, 2, 3):
        totals: dict = defaultdict(lambda: [0, 0.0])
        for g, v in counts[k].items():
            totals[g[:-1]][0] += v
            totals[g[:-1]][1] += discount[k][min(v, 3)]
        context[k] = dict(totals)

    def probability(g: tuple) -> float:
        k = len(g)
        lower = 1 / len(counts[1]) if k == 1 else probability(g[1:])
        if g[:-1] not in context[k]:
            return lower
        total, mass = context[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (max(v - discount[k][min(v, 3)], 0.0) + mass * lower) / total

    rows = []
    for w in words:
        said = w[2:]
        if len(said) >= repetition.MIN_WORDS:
            mean = sum(math.log(probability(g)) for g in zip(w, w[1:], w[2:])) / len(said)
            rows.append((math.exp(-mean), repetition.repeated_words(said) / len(said) >= repetition.MIN_SHARE))
    order = sorted(rows)
    hits = np.cumsum([r[1] for r in order])
    print(f"{len(order)} texts, {hits[-1]} of them repetitive")
    for recall in (0.5, 0.9, 0.95, 0.99, 1.0):
        i = int(np.searchsorted(hits, recall * hits[-1]))
        print(f"recall {recall:.2f}: perplexity up to {order[i][0]:.1f}, precision {hits[i] / (i + 1):.3f}")


if __name__ == "__main__":
    main(sys.argv[1])
