import random
import re

import numpy as np
import pytest

from detlens.llm import neardup as N


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return sorted((r[0], len(s), least[g], r[0] == least[g]) for r, s, g in zip(rows, sets, group, strict=True))


def run(spark, rows, k=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.near_duplicates(df, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted(tuple(r) for r in got)


@pytest.fixture(scope="module")
def copies():
    """A large group whose members share a base text and differ by a few to many edits, and others."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**5)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 14)):
            w[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(150, 220):
        rows.append((i, " ".join(f"r{rng.randrange(500)}" for _ in range(rng.randrange(0, 60)))))
    rows += [(300 + i, rows[i][1].upper()) for i in range(5)] + [(400, None), (401, ""), (402, " \n"), (403, "a b"), (404, "A  b"), (405, "a b c"), (406, "a b c d e")]
    return rows


def test_equals_brute_force(spark, copies):
    assert run(spark, copies) == brute(copies, 4)


def test_five_words(spark, copies):
    assert run(spark, copies, 5) == brute(copies, 5)


def test_keys_meet_within_the_distance():
    """Pigeonhole: signatures that differ in DISTANCE components or fewer share a kept choice of some chunk."""
    rng = np.random.default_rng(0)
    for _ in range(2000):
        differ = np.zeros(N.COMPONENTS, dtype=bool)
        differ[rng.choice(N.COMPONENTS, rng.integers(0, N.DISTANCE + 1), replace=False)] = True
        assert (differ.reshape(N.CHUNKS, -1).sum(axis=1) <= N._OUT).any()


def test_odd_rows(spark, odd):
    rows = N.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count()
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert by[7].component_id == 6 and not by[7].kept and by[8].component_id == 6 and by[10].component_id == 9
    assert sum(r.kept for r in rows if r.doc_id == 8) == 0


def test_empty_table(spark, nothing):
    assert N.near_duplicates(nothing).collect() == []


def test_many_rows_without_a_key(spark):
    """They are told apart by their texts, and no pairs of rows are made to find a set again."""
    rng = random.Random(9)
    rows = []
    for i in range(500):
        w = [f"n{rng.randrange(10**5)}" for _ in range(40)]
        rows += [(None, " ".join(w)), (None, " ".join(w[:-1] + [f"x{i}"]))]
    rows += [(7, rows[0][1]), (8, "an id of two texts " * 9), (8, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = N.near_duplicates(df, shingle=4).collect()
    assert len(got) == len(rows) and all(r.n_shingles == 37 for r in got if r.doc_id is None)
    assert sum(r.component_id == 7 for r in got) == 3 and sum(r.component_id == 8 for r in got) == 4
