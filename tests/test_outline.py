"""The outline filter against a recursion, and on a deep chain."""

import random

from folioworks.operators import pages

SCHEMA = "revision_id int, node_id int, parent_id int, depth int, page int"


def survivors(rows, kept):
    """Ids that stay in one revision's outline."""
    below = {}
    for _, node, parent, depth, page in rows:
        below.setdefault(None if depth == 0 else parent, []).append((node, page))

    def walk(node, page):
        if page is not None and page not in kept:
            return set()
        found = set().union(*(walk(*child) for child in below.get(node, []))) if node in below else set()
        return found | {node} if page is not None or any(child in found for child, _ in below.get(node, [])) else set()

    return set().union(*(walk(*root) for root in below.get(None, [])), set())


def run(spark, rows, kept):
    keep = spark.createDataFrame(kept, "revision_id int, old_idx int, new_idx int")
    got = pages.filter_outline(spark.createDataFrame(rows, SCHEMA), keep).collect()
    return sorted(((r.revision_id, r.node_id, r.page) for r in got), key=lambda r: r[:2])


def test_random_outlines(spark):
    rng, rows, kept = random.Random(5), [], []
    for revision in range(12):
        made = []
        for node in range(rng.randint(1, 60)):
            parent = rng.choice(made[-6:]) if made and rng.random() < 0.85 else None
            depth = 0 if parent is None else parent[3] + 1
            made.append((revision, node, parent and parent[1], depth, rng.choice([None, None, *range(9)])))
        rows += made
        kept += [(revision, p, p * 2) for p in range(9) if rng.random() < 0.8]
    want = []
    for revision in range(12):
        own, new = [r for r in rows if r[0] == revision], {o: n for v, o, n in kept if v == revision}
        stay = survivors(own, new)
        want += [(revision, r[1], new.get(r[4])) for r in own if r[1] in stay]
    assert run(spark, rows, kept) == sorted(want, key=lambda r: r[:2])


def test_a_chain_of_a_thousand_levels_missing_parents_and_circles(spark):
    chain = [(1, k, k - 1 if k else None, k, None) for k in range(1000)] + [(1, 1000, 999, 1000, 3)]
    cut_off = [(2, k, k - 1 if k else None, k, 7 if k == 500 else None) for k in range(600)] + [(2, 600, 599, 600, 3), (2, 601, 100, 101, 3)]
    odd = [(3, 1, 99, 1, 3), (3, 2, None, 1, 3), (3, 4, 5, 1, 3), (3, 5, 4, 1, 3), (3, 6, None, 0, 3)]
    got = run(spark, chain + cut_off + odd, [(v, 3, 0) for v in (1, 2, 3)])
    assert [n for v, n, _ in got if v == 1] == list(range(1001))
    assert [n for v, n, _ in got if v == 2] == [*range(101), 601]
    assert [n for v, n, _ in got if v == 3] == [6]
    assert run(spark, [], []) == []
