"""What keeps plans whole on large tables, and what they give there against brute force."""

import random
import re

import pytest

from waveloom import plans
from waveloom.functions import names as N
from waveloom.operators import intervals as I
from waveloom.operators import windows as X

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_inside_intervals(spark, how):
    rnd = random.Random(4)
    rows = [(r, b, f"{r}/{b}") for r in range(4) for b in range(30)] + [(None, 1, "none")]
    ivals = [(r, x, a, a + rnd.randrange(0, 9)) for r in range(3) for x in "pq" for a in (0, rnd.randrange(25), 28)] + [(None, "p", 0, 9)]
    hits = [(r, b, v, x) for r, b, v in rows for q, x, a, e in ivals if r is not None and r == q and a <= b < e]
    held = {(r, b) for r, b, _, _ in hits}
    none = [x for x in rows if x[:2] not in held]
    want = {"inner": hits, "left": hits + [(*x, None) for x in none], "left_semi": [x for x in rows if x[:2] in held], "left_anti": none}[how]
    got = I.inside(spark.createDataFrame(rows, "rec long, bin long, v string"), spark.createDataFrame(ivals, "rec long, label string, b0 long, b1 long"), how=how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Broadcast" not in plan_of(got)


#: Bins of intervals come from explode(), whose estimated size is that of the small table below it.
UNEXPLODED = """
a20_interval_statistic w6_interpolate_artifacts a9_interval_maxima a39_p_values p21_labelled_rows a4_grouping_modes a40_histogram a39_t_test a2_state_stats
""".split()


@pytest.mark.parametrize("name", UNEXPLODED)
def test_bins_of_intervals_are_not_broadcast(spark, name):
    plan = plan_of(plans.QUERIES[name](spark, SF))
    assert "explode(sequence(" not in plan and re.search(r"SortMergeJoin \[(rec|l_suppkey)#\d+L?\], \[__rec#", plan)


def test_features_with_the_same_labels_share_their_masks(spark):
    rnd = random.Random(9)
    lfp, src = [f"LFP{s}{i:02d}" for s in "LR" for i in range(3)], [f"msrc{s}_9_{p}_c0" for s in "LR" for p in range(3)]
    feats = [(f"H_act_{c}", c, None) for c in lfp + src] + [(f"con_{b}_{x},{y}", x, y) for b in ("beta", "gamma") for x in lfp for y in src]
    arts = [(r, x, a, a + rnd.randrange(0, 12)) for r in range(5) for x in ("BAD_LFPR", f"BAD_LFPL{r % 3:02d}", "BAD_MEGL", "BAD_other") for a in (0, rnd.randrange(30))]
    labels = lambda c: {f"BAD_{'LFP' if c[0] == 'L' else 'MEG'}", f"BAD_{'LFP' + c[3] if c[0] == 'L' else 'MEG' + c[4]}", f"BAD_{c}"}
    some = {x for _, x, a, e in arts if e > a}
    sets = {f: frozenset(set().union(*(labels(c) for c in cs if c)) & some) for f, *cs in feats}
    bins = {(f, r): {b for q, x, a, e in arts if q == r and x in sets[f] for b in range(a, e)} for f in sets for r in range(5)}
    f = spark.createDataFrame(feats, "feat string, ch1 string, ch2 string")
    a = spark.createDataFrame(arts, "rec long, label string, b0 long, b1 long")
    got = {(r.feat, r.rec): {b for x in r.bins for b in range(x.b0, x.b1)} for r in N.artifact_masks(f, a).collect()}
    assert got == {k: v for k, v in bins.items() if v}
    found, masks = N.mask_sets(f, a)
    assert {r.feat: frozenset(r.labels) for r in found.collect()} == {f: x for f, x in sets.items() if x}
    # a row a set and recording, however many features share it
    assert masks.count() == len({(sets[f], r) for (f, r), v in bins.items() if v}) < len(got) / 4
    assert "Broadcast" not in plan_of(masks.select("n_bins"))


def test_masked_inside_intervals_that_overlap(spark):
    rows = [(r, b, float(b)) for r in range(3) for b in range(20)]
    bad = [(0, 2, 6), (0, 4, 9), (0, 4, 5), (0, 15, 15), (1, 0, 1), (1, 18, 40), (3, 0, 9)]
    want = sorted((r, b, None if any(q == r and a <= b < e for q, a, e in bad) else v) for r, b, v in rows)
    got = X.masked_inside(spark.createDataFrame(rows, "rec long, bin long, v double"), spark.createDataFrame(bad, "rec long, b0 long, b1 long"), ["rec"])
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:2]) == want
