"""Near copies by five-word shingles against brute force."""

import numpy as np

import corpus_pipeline
from tempolith.llm import simhash

from .test_corpus_operators import roots_of
from .test_text_operators import docs


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def expected(rows):
    near = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if 10 * len(grams(a[1]) & grams(b[1])) >= 8 * len(grams(a[1]) | grams(b[1]))]
    roots = roots_of(near, range(len(rows)))
    return {min(r[0] for k, r in enumerate(rows) if roots[k] == root) for root in set(roots.values())}


def test_pipeline_drops_scattered_edits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for edits in (0, 2, 4, 6, 7, 12, 20, 0):
            words = list(base)
            for at in rng.choice(300, edits, replace=False):
                words[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, " "), (1002, "a b"), (1003, "A  b")]
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected(rows))
    assert kept.columns == docs(spark, []).columns and simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_pairs_of_the_least_similarity_are_proposed():
    """Share of pairs at similarity 0.8 to 0.9, by single edits and by an added passage, that meet in a probed bucket."""
    rng = np.random.default_rng(4)
    mask = [np.uint64(((1 << 21) - 1) << (21 * i)) for i in range(3)]
    for kind in ("edits", "passage"):
        met = 0
        for _ in range(60):
            words = [b"w%d" % x for x in rng.zipf(1.3, 600) % 20000]
            other = list(words)
            if kind == "edits":
                for at in rng.choice(600, 11, replace=False):
                    other[at] = b"new%d" % rng.integers(0, 10**6)
            else:
                other += [b"w%d" % x for x in rng.zipf(1.3, 60) % 20000]
            a, b = (simhash.table_prints(simhash.shingles(b" ".join(x), simhash.PROBE_WORDS)) for x in (words, other))
            met += any(((a ^ b) & m == 0).any() for m in mask)
            assert sum(int(x) for x in np.bitwise_count(a[: simhash.LOOSE] ^ b[: simhash.LOOSE])) <= simhash.LOOSE_TAU
        assert met >= 54
