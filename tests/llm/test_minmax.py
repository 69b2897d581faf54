"""Min-max near-dedup against all pairs, and the bands against their theory."""

import random
import re

import numpy as np
import pytest

from tidegrain.llm import minmax

SCHEMA = "doc_id long, text string, comp string, bands long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def shingles(text, n=4):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < n:
        return {(tuple(words), "short")} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def by_all_pairs(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                comp[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        smallest = min(ids) if ids else None
        out.append((d, len(sets[i]), smallest, d == smallest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def near_copies(seed, groups, copies, words=60):
    """Texts around the threshold: some words of each copy are replaced at one place."""
    r = random.Random(seed)
    rows, d = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            at, k = r.randrange(words), r.randrange(0, 9)
            own[at : at + k] = [f"x{r.randrange(10**6)}" for _ in range(k)]
            rows.append((d, " ".join(own)))
            d += 1
    r.shuffle(rows)
    return rows


AWKWARD = [
    (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a b c d"), (907, "A B C D"), (None, "a b c d"), (908, "É x y z é"), (909, "é x y z é"),
    (906, "a b c d"), (None, None), (910, "\x1c a b c d"), (911, " ".join(f"v{i}" for i in range(20000))), (912, " ".join(f"v{i}" for i in range(20100))), (None, "lone words of no id here"), (913, "a a a a a a a a"), (914, "a a a a"),
]


@pytest.mark.parametrize("few", [minmax.FEW, 1])
def test_components_are_those_of_all_pairs(spark, few):
    rows = near_copies(7, 14, 9) + AWKWARD
    assert got(minmax.components(table(spark, rows), few=few)) == by_all_pairs(rows)


def test_tables_without_links(spark):
    assert got(minmax.components(table(spark, []))) == []
    rows = [(1, None), (2, ""), (3, "a b c d e"), (4, "f g h i j")]
    assert got(minmax.components(table(spark, rows))) == by_all_pairs(rows)


def test_classes_that_share_bands_but_no_link_are_solved_exactly(spark):
    """A template of two thirds of each text fills bands with texts that are not similar; pairs of near copies hide among them."""
    r = random.Random(3)
    template = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = [f"o{i}_{j}" for j in range(24)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 6 == 0:
            own[r.randrange(24)] = "edit"
            rows.append((2 * i + 1, " ".join(template + own)))
    assert got(minmax.components(table(spark, rows), few=4)) == by_all_pairs(rows)


def test_bands_are_shared_as_often_as_similarity_says():
    r = np.random.default_rng(1)
    factors = minmax.multipliers(minmax.ROWS * minmax.GROUPS)
    share, errors, missed = [], [], 0
    for _ in range(300):
        both = r.integers(0, 1 << 63, 80, dtype=np.uint64)
        a = np.concatenate([both, r.integers(0, 1 << 63, 10, dtype=np.uint64)])
        b = np.concatenate([both, r.integers(0, 1 << 63, 10, dtype=np.uint64)])
        same = minmax.bands(a, factors) == minmax.bands(b, factors)
        share.append(same.mean())
        missed += not same.any()
        errors.append(minmax.estimate(a, b, factors) - 0.8)
    assert missed == 0
    assert abs(np.mean(share) - 0.8**minmax.ROWS) < 0.02
    # 125 permutations give 250 values; independent ones would have this spread, minima alone one 1.4 times as wide.
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 1.1 * (0.16 / 250) ** 0.5


def test_extremes_of_pieces_are_those_of_the_whole(monkeypatch):
    s = np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64)
    factors = minmax.multipliers(10)
    whole = minmax.extremes(s, factors)
    monkeypatch.setattr(minmax, "PIECE", 7)
    assert all((x == y).all() for x, y in zip(whole, minmax.extremes(s, factors), strict=True))
    assert all(int(f) % 2 for f in factors) and len(set(factors.tolist())) == 10
