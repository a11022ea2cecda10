"""Filter audit, centroid clustering and packing against brute force and on odd input."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm import audit, centroids, packing, queries
from tests.check_oracle import compare, duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000


# ---- filter audit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def slow_audit(rows, labels):
    """Every order walked through document by document; rows: (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        out = set()
        out |= {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        out |= {"D"} if set(text) & set("#$%&*|") else set()
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            out |= {"E"}
        fails.append((i, part or "", out))
    got = {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        removed_of = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                removed_of[letter] += len(gone)
                got[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in own) - len(gone),
                    sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in got.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return got


def test_audit_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    pool = [None, "", " \n", "ALL CAPS", "a#b", LONG[:3000], "x " * 300]
    pool += [" ".join(rng.sample(words, rng.choice([50, 250]))) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3]) for _ in range(25)]
    rows = [(i, rng.choice(pool), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(None, pool[7], "en"), (None, pool[7], "en"), (7, rows[7][1], "en"), rows[3]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, True, "s") for r in rows], "doc_id long, text string, lang string, mask int, good boolean, digest string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS part", "doc_id AS first")
    got = {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in audit.audit(docs, marks).collect()}
    assert got == slow_audit(rows, labels)
    assert audit.audit(docs.where("doc_id < 0"), marks).count() == 0
    assert audit.audit(docs, marks.where("doc_id < 0")).where("good_lost + toxic_lost > 0").count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
@settings(deadline=None)
def test_positional_popcount(words):
    got = audit.positional_popcount(np.array(words, dtype=np.uint32))
    assert got.tolist() == [sum(w >> i & 1 for w in words) for i in range(32)]


def test_survival_words():
    for mask, word in enumerate(audit.WORDS.tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(not mask & s) for s in range(32)]


def test_many_parts_pass_on_in_groups(spark, monkeypatch):
    monkeypatch.setattr(audit, "GROUPS", 5)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('t', id) AS text", "concat('p', id % 40) AS lang")
    got = audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where("filter_order = 'BACDE' AND step = 1").groupBy().sum("kept").first()[0] == 300
    assert got.count() == 40 * 600


def test_audit_query(spark, sf):
    fn = queries.QUERIES["op12_filter_audit"]
    ok, message = compare(spark, duck(sf), "op12_filter_audit", fn, queries.ORACLES["op12_filter_audit"], sf)
    assert ok, message


# ---- centroid clustering


def slow_clusters(rows, k=40, dims=64, rounds=5):
    limit = centroids.LIMIT
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(max(-limit, min(limit, np.floor(256 * float(x))))) for x in v]) for i, v in kept]

    def digest(i):
        return (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())

    middle = [v for _, v in sorted(whole, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))[::-1]

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in whole:
            own[nearest(v)[0]].append(v)
        middle = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(middle)]
    found = [(i, *nearest(v)) for i, v in whole]
    inertia = collections.Counter()
    for _, n, d in found:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return collections.Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, n, d in found)


def embeddings(spark, rows, kind="float"):
    rows = [(i, v, 1, "x", 2) for i, v in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster int, id string, distance int")


def got_clusters(df, **how):
    rows = centroids.cluster(df, **how).drop("centroid").collect()
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


@pytest.mark.parametrize("grid", [1.0, 1 / 256])
def test_clusters_against_brute_force(spark, grid):
    """A coarse grid makes ties between centroids; repeated vectors and ids make equal centroids."""
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(0, 1, (120, 64)) / grid) * grid
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(i, points[i % 3].tolist()) for i in range(100, 140)]
    rows += [(None, points[0].tolist()), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [0.0] * 64)]
    rows += [(205, [None] + [1.0] * 63), (206, [float("nan")] * 64), (207, [float("inf")] + [0.0] * 63), (208, [1e6] + [-1e6] * 63)]
    df = embeddings(spark, rows, "double")
    assert got_clusters(df) == slow_clusters(rows)


def test_clusters_of_few_vectors(spark):
    few = [(i, [float(i), 0.5]) for i in range(3)] + [(3, [0.0, 0.5])]
    assert got_clusters(embeddings(spark, few), dims=2, rounds=2) == slow_clusters(few, dims=2, rounds=2)
    assert got_clusters(embeddings(spark, []), dims=2) == collections.Counter()
    assert got_clusters(embeddings(spark, [(1, None), (2, [1.0])]), dims=2) == collections.Counter()
    far = [(1, [1e30, -1e30]), (2, [-1e30, 1e30]), (3, [0.0, 0.0])]
    assert got_clusters(embeddings(spark, far), dims=2, k=2) == slow_clusters(far, dims=2, k=2)


def test_walk_stops_before_all_centroids_are_seen(monkeypatch):
    """The lists are left early where clusters lie apart, and the result is the exact one."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-2000, 2000, (40, 64))
    vectors = middle[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 64))
    seen = []
    plain = np.nonzero
    monkeypatch.setattr(centroids.np, "nonzero", lambda x: seen.append(int(x.sum())) or plain(x))
    number, distance = centroids.Lists(middle).nearest(vectors)
    monkeypatch.undo()
    exact = ((vectors[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert sum(seen) < 0.6 * 500 * 40


def test_clustering_query(spark, sf):
    got = queries.QUERIES["op11_centroid_clustering"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == slow_clusters(rows)


# ---- packing


def padding(runs, capacity):
    return sum(r.count * (capacity - r.used) for r in runs if r.used.bit_count() != 1)


@given(
    st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=12),
    st.integers(1, 6),
)
@settings(deadline=None, max_examples=200)
def test_runs_hold_every_token_once(histogram, least_room):
    runs = packing.fill_by_cutting(packing.shortest_pack_first(histogram, 32), 32, least_room)
    places = packing.Placements(runs)
    seen = collections.defaultdict(set)
    for length, count in histogram.items():
        ranks = np.arange(count)
        for parts in places.find(np.full(count, length), ranks).to_pylist():
            at = 0
            for part in parts:
                assert part["inside"] == at and part["tokens"] > 0
                at += part["tokens"]
                spots = set(range(part["offset"], part["offset"] + part["tokens"]))
                assert not spots & seen[part["sequence_id"]]
                seen[part["sequence_id"]] |= spots
            assert at == length
    assert all(s == set(range(len(s))) and len(s) <= 32 for s in seen.values())
    assert sorted(seen) == list(range(len(seen)))
    assert all(r.used.bit_count() == 1 or 32 - r.used < least_room for r in runs)


def test_shortest_pack_first():
    """Item by item: the longest next, into the pack that is shortest, or a new one."""
    rng = random.Random(2)
    for _ in range(30):
        histogram = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 65), rng.randrange(1, 20))}
        packs = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            at = min(range(len(packs)), key=packs.__getitem__, default=None)
            if at is None or packs[at] + n > 64:
                packs.append(n)
            else:
                packs[at] += n
        runs = packing.shortest_pack_first(histogram, 64)
        assert sorted(u for r in runs for u in [r.used] * r.count) == sorted(packs)


def test_runs_do_not_grow_with_the_input():
    small = {n: 5_000 // n for n in range(1, 2049)}
    large = {n: 1000 * c for n, c in small.items()}
    counts = []
    for histogram in (small, large):
        runs = packing.fill_by_cutting(packing.shortest_pack_first(histogram, 2048), 2048, 16)
        counts.append(sum(len(r.parts) for r in runs))
        assert padding(runs, 2048) <= 0.005 * sum(n * c for n, c in histogram.items())
    assert counts[1] < 10 * counts[0]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    return text, Tokenizer.from_str(text)


ODD = [None, "", "  \n\t ", "a", "A b c\x1fd", "İstanbul é ́x ﬁ", "<|endoftext|> a<|startoftext|>b", "don't we'LL 's", "日本語 ▁ x\r\ny z", "a" * 5000]


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    text, reference = tokenizer
    rng = random.Random(1)
    letters = "ab' \n\t \x1c.,<|>ſßİÉé日1²"
    texts = [t or "" for t in ODD] + ["".join(rng.choices(letters, k=60)) for _ in range(500)]
    for encoder in (packing.Encoder(text), packing.Encoder(text, cache_size=3, longest=2)):
        for t in texts:
            assert np.frombuffer(encoder.ids(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids


def check_packing(rows, want, max_tokens, least_room):
    """rows of pack(); want: ids by doc id."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(want)
    for i, ids in want.items():
        own, at = sorted(by[i], key=lambda r: r.start), 0
        for r in own:
            assert (r.start, r.doc_tokens, r.length > 0) == (at, len(ids), True)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    total = lost = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens
        total += at
        lost += 0 if at.bit_count() == 1 else max_tokens - at
        assert at.bit_count() == 1 or max_tokens - at < least_room
    assert lost <= 0.01 * total


def test_packing_odd(spark, tokenizer):
    texts = [*ODD, LONG, *ODD, *["same words here"] * 50]
    docs = spark.createDataFrame([(i, t, 1, b"x", 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, ids binary, chunk int")
    want = {i: tokenizer[1].encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    for spread in (1, 7):
        check_packing(packing.pack(docs.repartition(spread), tokenizer=tokenizer[0]).collect(), want, 2048, 16)
    assert packing.pack(docs.where("doc_id < 0")).count() == 0
    # rows without an id or with the same one keep all their tokens
    twice = docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text").unionAll(docs.select("doc_id", "text")).unionAll(docs.select("doc_id", "text"))
    assert packing.pack(twice).groupBy().sum("length").first()[0] == 3 * sum(map(len, want.values()))


def test_packing_query(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: tokenizer[1].encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    check_packing(packing.pack(docs).collect(), want, 2048, 16)
    got = queries.QUERIES["op13_packing"](spark, sf).collect()
    for r in got:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
    assert sum(r.length for r in got) == sum(map(len, want.values()))
