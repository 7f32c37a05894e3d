import random

import pytest

from pageloom.plans.insertion import inserted, insertion_counts, resolved

SCHEMA = "doc_id long, rule_id string, target_page int, insert_mode string, n int, original_index int"

# Known answers: rules as (id, target, mode, pages, index), then the pages they land on in planned order.
CASES = [
    ([("T", 2, "after", 1, 0)], [("T", 2)]),
    ([("A", 2, "after", 1, 0), ("B", 5, "after", 1, 1)], [("A", 2), ("B", 6)]),
    ([("A", 3, "before", 2, 0), ("B", 3, "after", 1, 0)], [("A", 3), ("B", 5)]),
    ([("A", 2, "replace", 3, 0), ("B", 5, "after", 1, 0)], [("A", 2), ("B", 7)]),
    ([("B", 3, "after", 1, 0), ("A", 3, "before", 1, 1)], [("A", 3), ("B", 4)]),
    ([("R4", 5, "replace", 1, 3), ("R3", 2, "after", 1, 2), ("R2", 2, "replace", 1, 1), ("R1", 1, "before", 1, 0)], [("R1", 1), ("R2", 3), ("R3", 3), ("R4", 7)]),
]


@pytest.mark.parametrize("rules, want", CASES)
def test_known_offsets(spark, rules, want):
    df = spark.createDataFrame([(1, *r) for r in rules], SCHEMA)
    assert [(r["rule_id"], r["adjusted_page"]) for r in resolved(df).orderBy("plan_no").collect()] == want


def simulated(pages, rules):
    """Rules one after another on a list, each where the plan says."""
    rank = {"before": 0, "replace": 1, "after": 2}
    order = sorted(rules, key=lambda r: (r[1], rank[r[2]], r[4], r[0]))
    doc = [("own", p) for p in pages]
    for i, (rule, target, mode, n, _) in enumerate(order):
        at = target
        for _, t, m, k, _ in order[:i]:
            if t < target or m == "before" or (m == "replace" and mode == "after"):
                at += k - (m == "replace")
        block = [(rule, j) for j in range(1, n + 1)]
        if mode == "before":
            doc[at - 1 : at - 1] = block
        elif mode == "replace":
            doc[at - 1 : at] = block
        else:
            doc[at:at] = block
    return doc


def test_closed_form_against_simulation(spark):
    rng, rules, want = random.Random(3), [], {}
    for d in range(150):
        own = [(f"r{i}", rng.randint(1, 4), rng.choice(["before", "replace", "after"]), rng.randint(1, 3), rng.randint(0, 3)) for i in range(rng.randint(0, 6))]
        rules += [(d, *r, f"s{r[0]}", list(range(1, r[3] + 1))) for r in own]
        want[d] = simulated([1, 2, 3, 4], own)
    pages = spark.createDataFrame([(d, p) for d in want for p in (1, 2, 3, 4)], "doc_id long, page_no int")
    df = spark.createDataFrame(rules, SCHEMA + ", source_file_id string, source_list array<int>")
    got = {}
    for r in inserted(pages, df).orderBy("doc_id", "out_page").collect():
        got.setdefault(r["doc_id"], []).append(("own", r["page_no"]) if r["page_no"] else (r["rule_id"], r["source_page"]))
    assert got == want
    assert {r["doc_id"]: r["final_pages"] for r in insertion_counts(pages, df).collect()} == {d: len(x) for d, x in want.items()}
