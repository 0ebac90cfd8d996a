"""Interval-encoded versions: each version comes back, differences, and merges taken back."""

import random

from recordloom.operators import versions as V

SCHEMA = "ID string, title string, year string, origins string, status string"


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def rows(df):
    return {r.ID: (r.title, r.year, r.origins, r.status) for r in df.select("ID", "title", "year", "origins", "status").collect()}


def test_versions_come_back(spark):
    rng = random.Random(4)
    states, now = [], {}
    for n in range(6):
        now = dict(now)
        for _ in range(8):
            k = f"R{rng.randint(0, 14)}"
            if rng.random() < 0.25:
                now.pop(k, None)
            else:
                now[k] = (rng.choice(["a", "b", None]), rng.choice(["1", None]), f"s/{k}", "x")
        states.append(now)
    intervals = V.first_version(frame(spark, states[0]))
    for n, state in enumerate(states[1:], 1):
        intervals = V.materialize(V.next_version(intervals, frame(spark, state), n), "versions")
    for n, state in enumerate(states):
        assert rows(V.at_version(intervals, n)) == state
    for a, b in ((0, 5), (1, 2), (2, 2), (0, 3)):
        want = {k: "added" if k not in states[a] else "removed" if k not in states[b] else "changed" for k in states[a].keys() | states[b].keys() if states[a].get(k) != states[b].get(k)}
        assert {r.ID: r.change for r in V.version_diff(intervals, a, b).collect()} == want
    # equal rows in a row are one interval
    runs = sum(states[n].get(k) is not None and (n == 0 or states[n].get(k) != states[n - 1].get(k)) for k in {k for s in states for k in s} for n in range(6))
    assert intervals.count() == runs


def test_unmerge(spark):
    v0 = {"A": ("T", "1", "s/1", "md_prepared"), "B": ("T", "1", "t/1", "md_prepared"), "C": ("T.", None, "u/1", "md_prepared"), "D": ("other", "2", "s/2", "md_prepared"), "E": ("pair", "3", "s/3", "md_imported"), "F": ("pair", "3", "t/3;x/1", "md_prepared")}
    v1 = {"A": ("T", "1", "s/1;t/1", "md_processed"), "C": v0["C"], "D": v0["D"], "E": ("pair", "3", "s/3;t/3;x/1", "md_processed")}  # first merges
    v2 = {"A": ("T", "1", "s/1;t/1;u/1", "md_processed"), "D": v0["D"], "E": v1["E"]}  # C, too
    v3 = {"A": ("T", "1999", "u/1;t/1;s/1", "rev_included"), "D": ("other!", "2", "s/2", "md_prepared"), "E": v1["E"]}  # edits, origins in another order
    intervals = V.first_version(frame(spark, v0))
    for n, v in enumerate((v1, v2, v3), 1):
        intervals = V.next_version(intervals, frame(spark, v), n)
    intervals = V.materialize(intervals, "versions")
    back = lambda *ids: rows(V.unmerge(intervals, spark.createDataFrame([(i,) for i in ids], "ID string")))
    done = lambda r: (*r[:3], "md_processed")
    assert back("A") == {"A": done(v1["A"]), "C": done(v0["C"]), "D": v3["D"], "E": v3["E"]}  # the last merge only
    assert back("E") == {"A": v3["A"], "D": v3["D"], "E": done(v0["E"]), "F": done(v0["F"])}
    assert back("A", "E", "E") == {"A": done(v1["A"]), "C": done(v0["C"]), "D": v3["D"], "E": done(v0["E"]), "F": done(v0["F"])}
    assert back("D") == v3 and back("nobody") == v3  # never merged
    assert {r.ID: r.changed for r in V.changed_in(intervals, 3).collect()} == {"A": True, "D": True, "E": False}
    assert {r.ID: r.changed for r in V.changed_in(intervals, 2).collect()} == {"A": True, "D": False, "E": False}
    assert V.unmerge(V.first_version(frame(spark, {})), spark.createDataFrame([], "ID string")).collect() == []
