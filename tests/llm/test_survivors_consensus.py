import datetime as dt
import random

import pytest

from rankloom.llm import consensus, survivors

CAND = "candidate_id long, roster_id long, name string, title string, age int, pay double, source_type string, precedence int, verification_status string, extracted_at timestamp, value string, g string"
TIERS = {"sec_filing": 1, "Annual Report": 1, " firm-website": 2, "LinkedIn provided": 3}


def brute(rows):
    out = set()
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    for g, rs in groups.items():
        if len(rs) < 2:
            continue
        for f in ("title", "age", "pay"):
            best = None
            for r in rs:
                if (r[8] or "").strip().lower() == "unverified":
                    continue
                v = {"title": r[3], "age": r[4], "pay": r[5]}[f]
                ok = v is not None and {"title": lambda: v.strip().lower() not in ("", "nan", "tbd", "?", "n/a"), "age": lambda: 18 <= v <= 100, "pay": lambda: v > 0 and v != float("inf")}[f]()
                if not ok:
                    continue
                tier = TIERS.get(r[6], r[7] if r[7] is not None else 10**6)
                key = (tier, -(r[9].timestamp() if r[9] else -1e12), r[0])
                best = min(best, (key, r[0])) if best else (key, r[0])
            if best:
                out.add((g, f, best[1]))
    return out


def test_survivors_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 4)) if rng.random() < 0.8 else None
        g = rng.choice([None, 1, 1, 1, *range(2, 300)])
        rows.append((i, g, "x", rng.choice([None, "", "nan", "TBD", "?", " ", "Head", " head", "Chair"]), rng.choice([None, -1, 17, 18, 40, 100, 999]), rng.choice([None, 0.0, -1.0, 5.0, float("nan"), float("inf")]), rng.choice([None, "", "unheard of", *TIERS]), rng.choice([None, 1, 2, 99]), rng.choice([None, "verified", "unverified", "Unverified ", "skipped"]), at, "clash", "clash"))
    df = spark.createDataFrame(rows, CAND)
    got = [tuple(r) for r in survivors.survive(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert survivors.survive(df.limit(0)).count() == 0
    voted = survivors.discover(df).values.collect()
    assert {(r.roster_id, r.field) for r in voted} == {g[:2] for g in got} and all(0 <= r.support <= 1 for r in voted)
    assert survivors.discover(df.limit(0)).values.count() == 0


def test_votes_alone_find_the_value_of_reliable_sources(spark):
    rows = []
    for g in range(200):  # two bad websites against one good filing: the filings' reliability must win where websites agree by chance
        rows += [(len(rows), g, "x", "Truth %d" % g, None, None, "sec_filing", None, "verified", None, "", ""), (len(rows) + 1, g, "x", "Truth %d" % g, None, None, "annual_report", None, "verified", None, "", ""), (len(rows) + 2, g, "x", "Wrong %d" % g, None, None, "firm_website", None, "verified", None, "", "")]
        if g % 3 == 0:
            rows.append((len(rows), g, "x", "Wrong %d" % g, None, None, "firm_website", None, "verified", None, "", ""))
    got = survivors.discover(spark.createDataFrame(rows, CAND))
    assert got.values.filter("value like 'truth%'").count() == 200
    assert got.reliability[("filing", "title")] > 0.9 > 0.1 > got.reliability[("website", "title")]


CORR = "correction_id long, node_id string, firm string, archetype string, region string, sub_industry string, original_level int, original_function string, corrected_level int, corrected_function string, analyst_id string, timestamp string, y string"


def test_consensus_beats_the_majority(spark):
    rng = random.Random(6)
    funcs = ["Sales", "HR", "R&D", "Legal"]
    good = {f"an-{i}": 0.9 if i < 6 else 0.1 for i in range(15)}  # nine of fifteen are nearly always wrong
    rows, truth, vote = [], {}, {}
    for n in range(400):
        node = f"n{n}"
        truth[node] = (rng.randint(1, 6), rng.choice(funcs))
        for a in rng.sample(sorted(good), 7):
            lv = truth[node][0] if rng.random() < good[a] else rng.randint(1, 6)
            fn = truth[node][1] if rng.random() < good[a] else rng.choice(funcs)
            vote.setdefault(node, []).append(fn)
            rows.append((len(rows), node, "f", "any", "EU", None, 3, funcs[n % 4], lv, rng.choice([fn] * 8 + [f" {fn.lower()} "]), rng.choice([a, f" {a.upper()} "]), "2024-01-0%dT00:00:00+00:00" % rng.randint(1, 9), "clash"))
    rows.append((len(rows), "n0", "f", None, None, None, None, None, None, " ", "an-0", "2024-02-01T00:00:00+00:00", ""))  # empty: the former stands
    rows.append((len(rows), "two", "f", None, None, None, None, None, 2, "HR", "an-0", "junk", ""))
    rows.append((len(rows), "two", "f", None, None, None, None, None, 2, "HR", None, None, ""))
    got = consensus.reach_consensus(spark.createDataFrame(rows, CORR), rounds=6)
    items = {r.node_id: r for r in got.items.collect()}
    joined = consensus.reach_consensus(spark.createDataFrame(rows, CORR), rounds=2, table_cells=0)  # the way for annotators of any number
    sent = consensus.reach_consensus(spark.createDataFrame(rows, CORR), rounds=2)
    key = lambda r: (r.node_id, r.corrected_level, r.corrected_function, round(r.function_confidence, 3), r.function_agreement)
    assert {key(r) for r in joined.items.collect()} == {key(r) for r in sent.items.collect()}
    assert {tuple(r) for r in joined.analysts.collect()} == {tuple(r) for r in sent.analysts.collect()}
    assert set(items) == set(truth)
    right = sum((r.corrected_level, r.corrected_function) == truth[n] for n, r in items.items()) / len(items)
    fright = sum(r.corrected_function == truth[n][1] for n, r in items.items()) / len(items)
    majority = sum(max(sorted(set(v)), key=v.count) == truth[n][1] for n, v in vote.items()) / len(vote)
    assert right > 0.85 and fright > majority + 0.05
    rel = {r.analyst: r.reliability for r in got.analysts.filter("field = 'func'").collect()}
    assert min(rel[f"an-{i}"] for i in range(6)) > max(rel[f"an-{i}"] for i in range(6, 15))


def test_more_classes_than_columns(spark):
    """Labels beyond the commonest share a column; a node's own commonest one wins."""
    rows = []
    for n in range(150):
        for a in range(4):
            rows.append((len(rows), f"n{n}", "f", None, None, None, None, None, n, f"Function {n}" if a < 3 else "Sales", f"an-{a}", "2024-01-01T00:00:00+00:00", ""))
    got = {r.node_id: (r.corrected_level, r.corrected_function) for r in consensus.reach_consensus(spark.createDataFrame(rows, CORR)).items.collect()}
    assert got == {f"n{n}": (n, f"Function {n}") for n in range(150)}


def test_consensus_of_nothing(spark):
    assert consensus.reach_consensus(spark.createDataFrame([], CORR), rounds=1).items.count() == 0
