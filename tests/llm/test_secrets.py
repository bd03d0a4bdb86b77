import random

import numpy as np
import pytest

from detlens.llm import secrets as S


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "er", "an", "on", "de"]) for _ in range(rng.randrange(1, 4)))
    some = lambda n: " ".join(word() for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = []
    for i in range(400):
        kind = i % 8
        middle = [f'token = "{hexes(40)}"', f"password={hexes(18)}", "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)),
                  str(rng.randrange(10**15, 10**16)), f"+1 ({rng.randrange(999)}) 555-{rng.randrange(1000, 9999)}", "", f"{rng.randrange(1900, 2030)}-01-0{rng.randrange(1, 9)}", f"a{rng.randrange(99)}"][kind]
        out.append((i, f"é {some(20)} {middle} {some(20)}", kind))
    return out


def test_finds_planted_secrets_and_no_others(spark, rows):
    found = S.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    secret = {r.doc_id for r in found if r.is_secret}
    assert secret == {i for i, _, k in rows if k < 3}
    for r in found:
        assert rows[r.doc_id][1][r.start: r.start + r.length] == r.candidate
    assert {r.doc_id for r in found} >= {i for i, _, k in rows if k in (3, 4, 6)}


def test_learns_from_given_findings(spark, rows):
    """Labels by hand that contradict the rules: here telephone numbers are what is looked for."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marked = S.candidates(docs.filter("doc_id < 200")).selectExpr("candidate", "before", "after", "cast(candidate like '555-%' as int) AS secret")
    found = S.scan(docs, marked).filter("doc_id >= 200").collect()
    assert {r.doc_id for r in found if r.is_secret} == {i for i, _, k in rows if k == 4 and i >= 200}


def test_forest_separates_and_is_deterministic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = S.Forest(x[:400], y[:400])
    assert ((forest.predict(x[400:]) >= 0.5) == y[400:]).mean() > 0.9
    assert (S.Forest(x[:400], y[:400]).predict(x) == forest.predict(x)).all()
    t = forest.trees[0]  # against a walk of one tree, row by row
    for row in x[:50]:
        at = 0
        while t[at, 0] >= 0:
            at = int(t[at, 2] if row[int(t[at, 0])] <= t[at, 1] else t[at, 3])
        assert 0 <= t[at, 4] <= 1
    one = S.Forest(x[:400], y[:400], trees=1)
    walk = []
    for row in x:
        at = 0
        while one.trees[0][at, 0] >= 0:
            n = one.trees[0][at]
            at = int(n[2] if row[int(n[0])] <= n[1] else n[3])
        walk.append(one.trees[0][at, 4])
    assert (one.predict(x) == np.array(walk)).all()


def test_labels_of_one_kind():
    assert S.Model([], []).scores([("abc12345", "", "")]).tolist() == [1.0]
    assert S.Model([("a1b2c3d4", "x", "y")], [0]).scores([("zz12345678", "", "")]).tolist() == [0.0]


def test_odd_rows(spark, odd, nothing):
    assert S.scan(odd).count() >= 0
    long = spark.createDataFrame([(1, "x " + "a1" * 300_000), (2, 'token="' + "0a" * 20 + '"'), (2, 'token="' + "0a" * 20 + '"'), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.length) for r in S.scan(long).collect())
    assert got == [(1, 2, 600_000), (2, 7, 40), (2, 7, 40)]
    assert S.scan(nothing).collect() == []


def test_short_and_letter_only_values_of_credentials_are_not_taught_as_clean():
    assert S.label("Tr0ub4dor9", "the password=") == 1 and S.label("kQzXvBnRtYwPsDfG", 'secret="') == 1
    assert S.label("abcdefg1", "password=") is None and S.label("getPasswordFromUser", "password = ") is None
    assert S.label("Tr0ub4dor9", "the word ") == 0 and S.label("kQzXvBnRtYwPsDfG", "the word ") == 0


def test_values_after_a_colon_and_spaces_are_candidates(spark):
    docs = spark.createDataFrame([(1, "password:  kqzxvbnrtywps end"), (2, '"said" something'), (3, "something"), (4, "a=")], "doc_id long, text string")
    assert [(r.key, r.candidate) for r in S.candidates(docs.coalesce(1)).collect()] == [(1, "kqzxvbnrtywps")]


def test_finds_short_passwords(spark, rows):
    rng = random.Random(4)
    short = lambda: "".join(rng.choice(x) for x in ("ABCDEFGH", "abcdefgh", "0123456789", "abcdefgh", "0123456789") * 2)
    more = [(1000 + i, f"and then the {'password=' if i % 2 else 'number '}{short()} was given") for i in range(100)]
    found = S.scan(spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r.is_secret and r.doc_id >= 1000} == {i for i, _ in more if i % 2}


def test_repeated_findings_take_one_place_in_the_sample(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marked = S.candidates(docs.filter("doc_id < 200")).selectExpr("candidate", "before", "after", "cast(candidate like '555-%' as int) AS secret")
    flood = spark.createDataFrame([("a1b2c3d4", f"n{i} ", "", 0) for i in range(3)] * 500, marked.schema)
    n = marked.distinct().count() + 3
    found = S.scan(docs, marked.unionByName(flood), train_rows=n).filter("doc_id >= 200").collect()
    assert {r.doc_id for r in found if r.is_secret} == {i for i, _, k in rows if k == 4 and i >= 200}
