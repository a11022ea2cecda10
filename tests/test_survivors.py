"""Survivors against brute force, with texts of every anchor length, odd characters and empty readings."""

import random

from folioworks.operators import redact


def test_survivors_match_brute_force_and_only_wanted_slots_are_exploded(spark):
    rng, alphabet = random.Random(5), "abß😀 é"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pages, texts = [], []
    for doc in [None, *range(12)]:
        for page in range(30):
            lines = [word(rng.choice([0, 3, 14, 40])) for _ in range(rng.choice([0, 1, 4]))]
            content = None if rng.random() < 0.1 else "\n".join(lines)
            pages.append((doc, page, content, [(t,) for t in lines] if rng.random() < 0.9 else None))
            if doc != 3 and lines and rng.random() < 0.5:
                t = rng.choice(lines)
                texts += [(doc, page, t), (doc, page, t[:2]), (doc, page, t + "zz"), (doc, page, "".join(lines)[:15])]
    redacted = spark.createDataFrame(pages, "revision_id long, page_index int, content string, spans array<struct<text: string>>")
    wanted = spark.createDataFrame(texts, "revision_id long, page_index int, text string")
    got = redact.verify_absent(redacted, wanted)
    expected = {
        (d, p, t, q, p == q)
        for d, p, t in texts if d is not None and t
        for e, q, content, spans in pages if e == d
        if t in (content or "") or t in "".join(s[0] for s in spans or [])
    }
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 100
    # a page's substrings are sieved before they are exploded
    assert "slots" in got._jdf.queryExecution().optimizedPlan().toString()
