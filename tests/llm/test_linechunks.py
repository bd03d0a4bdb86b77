import hashlib
import random
from collections import Counter

import pytest

from detlens.llm import linechunks as L


def solid(line):
    return line.replace(" ", "") != ""


def spans(lines, again):
    """(lo, hi) of the chunks of two or more repeated lines."""
    regions, open_ = [], None
    for pos, line in ((i, x) for i, x in enumerate(lines) if solid(x)):
        if line not in again:
            open_ = None
        elif open_ is None:
            regions.append(open_ := [pos])
        else:
            open_.append(pos)
    out = []
    for region in regions:
        x = [int(hashlib.md5(lines[p].encode()).hexdigest()[:8], 16) for p in region]
        v = [x[i] + 31 * (x[i - 1] if i else 0) for i in range(len(x))]
        cut = [i for i in range(1, len(v) - 2) if all(v[i] < w for w in v[max(0, i - 2):i]) and all(v[i] <= w for w in v[i + 1:i + 3])]
        begins = [0, *(i + 1 for i in cut), len(v)]
        for i, j in zip(begins, begins[1:]):
            if j - i > 1:
                out.append((region[i], region[j] - 1 if j < len(region) else region[-1]))
    return out


def brute(rows):
    count = Counter(x for _, t in rows if t is not None for x in t.split("\n") if solid(x))
    again = {x for x, n in count.items() if n > 1}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    seen, gone = set(), {}
    for key, text in order:
        lines = text.split("\n")
        for lo, hi in spans(lines, again):
            body = "\n".join(lines[lo:hi + 1])
            if body in seen:
                gone.setdefault((key, text), []).append((lo, hi))
            seen.add(body)
    out = []
    for key, text in rows:
        if text is None:
            out.append((key, 0, 0, 0, None))
            continue
        lines, mine = text.split("\n"), gone.get((key, text), [])
        kept = [x for i, x in enumerate(lines) if not any(lo <= i <= hi for lo, hi in mine)]
        out.append((key, len(lines), len(mine), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows):
    got = L.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted((tuple(r) for r in got.select("doc_id", "n_lines", "removed_chunks", "removed_lines", "text").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    shared = [f"shared line {i}" for i in range(12)]
    rows = [(i, "\n".join([f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))] + (shared if i % 3 else [])
                          + [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n \n"), (103, "\n".join(shared * 5)), (104, "é\r\nß\n\n日本\né\r\nß"), (105, rows[4][1])]
    return rows


def test_equals_brute_force(spark, rows):
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 60


def test_boundaries_survive_a_shift():
    passage = [f"line {i}" for i in range(60)]
    lead = ["x", "p", "q", "r", "s"]
    a, b = ([x[lo:hi + 1] for lo, hi in spans(x, set(passage + lead))] for x in (lead[:1] + passage, lead[1:] + passage))
    assert len(a) > 8 and len([c for c in a if c in b]) >= len(a) - 2


@pytest.mark.parametrize("length,blank", [(2, False), (3, False), (6, False), (12, False), (24, False), (12, True)])
def test_recall_of_planted_passages(spark, length, blank):
    """Of a passage that occurs twice among other lines all lines of the second copy go, and none of the others."""
    rng = random.Random(length)
    own = lambda: [f"own {rng.randrange(10**9)}" for _ in range(rng.randrange(1, 6))]
    rows, planted = [], 0
    for p in range(60):
        lines = [f"passage {p} line {i}" for i in range(length)]
        passage = [y for x in lines for y in ((x, "") if blank else (x,))][: 2 * length - 1 if blank else length]
        for copy in range(2):
            before, after = own(), own()
            rows.append((2 * p + copy, "\n".join(before + passage + after)))
        planted += len(passage)
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[3] for r in got) == planted


def test_no_python_in_the_plan(spark, sf_dir):
    plan = L.op10_line_chunks(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, odd, nothing):
    rows = L.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].text is None and by[2].text == "" and by[9].removed_chunks == 0 and by[10].removed_lines > 1000
    assert L.remove_repeats(nothing).collect() == []


def test_rows_of_one_key_keep_their_own_lines(spark):
    """A chunk is removed from the row that has it, not from another row of the same key or without one."""
    rng = random.Random(4)
    shared = [f"shared {i}" for i in range(60)]
    own = [[f"own {k} {rng.randrange(10**9)}" for _ in range(60)] for k in range(3)]
    text = "\n".join
    rows = [(1, text(shared)), (2, text(shared)), (2, text(own[0])), (None, text(shared)), (None, text(own[1])), (None, text(own[2]))]
    rows += [(None, text([f"line {i} of row {k}" for i in range(20)])) for k in range(1000)]
    got = L.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts = [r.text for r in got]
    assert len(got) == len(rows) and all(texts.count(t) == 1 for _, t in rows if t != text(shared))
    assert texts.count(text(shared)) == 1 and sum(r.removed_lines > 40 for r in got) == 2
