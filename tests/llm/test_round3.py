"""Document fingerprints, spelling variants and hard negatives against brute force, with odd input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import hard_negatives as H
from scorecraft.llm import imatch as I
from scorecraft.llm import spelling_variants as S

DOCS = "doc_id long, text string, term string, n long, bucket int"
VECS = "vec_id long, label int, embedding array<float>, row string, norm int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


# ---- fingerprints ------------------------------------------------------------------------

def brute_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        return sorted({w for w in re.split(I.BETWEEN, low) if w}, key=lambda w: w.encode())

    n = len(rows)
    df = {}
    for _, t in rows:
        for w in words(t):
            df[w] = df.get(w, 0) + 1
    lex = {w for w, d in df.items() if I.BAND[0] <= (math.log(n / d) / math.log(n) if n > 1 else 0) <= I.BAND[1]}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def print_of(t):
        has, out = [w for w in words(t) if w in lex], []
        for k, rate in enumerate(I.subset_rates()):
            some = [w for w in has if rate == 1 or int(md5(f"{k}|{w}")[:8], 16) % rate == 0]
            out.append(md5(" ".join(some))[:8] if some else "")
        return out if has else [md5(" ".join(words(t)))[:8]] * len(out)

    def near(a, b):
        either = sum(1 for x, y in zip(a, b) if x or y)
        return sum(1 for x, y in zip(a, b) if x == y and x) / max(1, either)

    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        h = len(t) // 2
        new = t[:len(t) - h] + after[:h]
        a, b, c = print_of(t), print_of(new), print_of(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), "-".join(a), "-".join(b), round(near(a, b), 9), round(near(a, c), 9)))
    return sorted(out, key=repr)


def got_fingerprints(df):
    return sorted((tuple(r[:5]) + (round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgéß日") for _ in range(r.randint(2, 6))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 30, 120])))) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(25)]  # copies
    rows += [(None, "No id here"), (None, rows[1][1]), (None, "No id here"), (7, "another text of the same id"), (8, rows[8][1]), (8, rows[8][1])]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "UPPER upper"), (304, " ".join(vocab * 40)), (305, "x" * 40_000), (-3, "É é 𝒳𝒳 y")]
    return rows


def test_fingerprints_equal_brute_force(spark, texts):
    assert got_fingerprints(I.fingerprints(docs(spark, texts))) == brute_fingerprints(texts)


def test_fingerprints_with_a_shuffled_lexicon_and_collapsed_copies(spark, texts, monkeypatch):
    monkeypatch.setattr(I, "HOT_ROWS", 1)
    got = got_fingerprints(I.fingerprints(docs(spark, texts), max_lexicon=1))
    assert got == brute_fingerprints(texts)


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(1, None)], [(1, "a b c"), (1, "a b c")], [(None, None)] * 3])
def test_fingerprints_of_tiny_tables(spark, rows):
    assert got_fingerprints(I.fingerprints(docs(spark, rows))) == (brute_fingerprints(rows) if rows else [])


def test_likeness_falls_with_the_share_of_changed_words(spark, texts):
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(4000)]
    base = [[r.choice(vocab) for _ in range(300)] for _ in range(400)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    out = I.fingerprints(docs(spark, rows)).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert out[0] > 0.03 > 0.01 > out[1]
    one = list(base[0])
    one[100] = "word7"
    fps = {x["doc_id"]: x["fingerprint"].split("-") for x in I.fingerprints(docs(spark, rows + [(1000, " ".join(one)), (1001, rows[0][1])])).collect()}
    same = sum(a == b for a, b in zip(fps[0], fps[1000])) / len(fps[0])
    assert fps[0] == fps[1001] and 0.6 < same < 1


def test_subsets_make_no_value_a_term_and_only_a_to_z_are_lower_cased(spark, texts):
    plan = I.fingerprints(docs(spark, texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(own" not in plan and "transform(new" not in plan and "filter(own" in plan
    listed = [k for ks in I.rare_subsets(I.RATES) for k in ks]
    assert sorted(listed) == [k for k, rate in enumerate(I.subset_rates()) if rate >= 8]
    rows = [(1, "ABC abc Z[z 9A"), (2, "ABC É é \u212a k İ ß AbC"), (3, ""), (4, "@Z`z{")]
    got = docs(spark, rows).select("doc_id", I.terms(F.col("text")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in got} == {1: ["abc", "z", "9a"], 2: ["abc", "É", "é", "\u212a", "k", "İ", "ß"], 3: [], 4: ["z"]}


# ---- spelling variants -------------------------------------------------------------------

def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counted, ratio=5):
    near = {w: [u for u in counted if one_edit(w, u)] for w in counted}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-counted[u], u), default=None)
        form[w] = best if best is not None and counted[best] >= ratio * counted[w] else None
    out = []
    for w, n in counted.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counted.get(form[w])))
    return sorted(out)


def brute_counts(rows, every=199, least_length=6, least=5):
    out = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least}


@pytest.mark.parametrize("leftward", [True, False])
def test_one_shard_finds_all_edits_of_its_half(leftward):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 9))) for _ in range(600)} | {"a" * 70, "a" * 71, "b" + "a" * 70})
    q, w = S.near_in_shard(words, np.arange(len(words)), leftward)
    got = set(zip(q.tolist(), w.tolist()))
    both = got | set(zip(*(x.tolist() for x in S.near_in_shard(words, np.arange(len(words)), not leftward))))
    assert all(one_edit(words[a], words[b]) for a, b in got)
    assert both == {(a, b) for a in range(len(words)) for b in range(len(words)) if one_edit(words[a], words[b])}


@pytest.mark.parametrize("shard", [10, 100, 32_768])
def test_variants_equal_all_pairs(spark, shard):
    """Small shards split the halves that many words have in common."""
    r = random.Random(shard)
    counted = {"".join(r.choice("abc") for _ in range(r.randint(1, 8))): r.choice([1, 2, 5, 9, 30, 200, 4000]) for _ in range(400)}
    counted |= {"prefix" + "".join(r.choice("xy") for _ in range(6)): r.randint(1, 900) for _ in range(60)}
    counted |= {"日本語": 5, "日本": 400, "𝒳": 3}
    words = spark.createDataFrame(list(counted.items()) + [(None, 3)], "word string, n long")
    assert sorted(map(tuple, S.group_variants(words, shard=shard).collect())) == brute_variants(counted)


def test_words_of_texts(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice("étaoinSHR") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(200)) + ",9xĀy") for i in range(40)]
    rows += [(None, "Weather weather WEATHER wéather Weather-weather " * 3), (3, None), (4, ""), (5, "!?"), (6, "q" * 30_000 + " ") ] + [rows[0]] * 4
    frame = docs(spark, rows)
    counted = brute_counts(rows, every=7)
    assert {r["word"]: r["n"] for r in S.word_counts(frame, every=7).collect()} == counted
    got = sorted(map(tuple, S.spelling_variants(frame, every=7).collect()))
    assert got == brute_variants(counted) and any(g[1] for g in got)


def test_variants_of_empty_tables(spark):
    assert S.spelling_variants(docs(spark, [])).collect() == []
    assert S.spelling_variants(docs(spark, [(1, None), (2, "a b")])).collect() == []


def test_roots_follow_long_chains(spark):
    words = {"a" * (6 + k): 6 ** k for k in range(9)}
    got = {r["word"]: r["root"] for r in S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 14}


# ---- hard negatives ----------------------------------------------------------------------

def brute_negatives(rows, every=100, k=5, low=80, high=100):
    import itertools
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    out = []
    for a, lab, v in ok:
        if a % every:
            continue
        scored = [(-dot(v, w), i, l2) for i, l2, w in ok]
        for s, p, _ in sorted(x for x in scored if x[2] == lab and x[1] != a)[:k]:
            fits = sorted((t, i) for t, i, l2 in scored if l2 != lab and low * -s <= high * -t <= high * -s)[:k]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in rows], VECS)


@pytest.fixture(scope="module")
def labelled():
    r = np.random.default_rng(6)
    centres = r.standard_normal((12, 8))
    x = (centres[r.integers(0, 12, 900)] + 0.15 * r.standard_normal((900, 8))).astype(np.float32)
    x[300:600] = x[300]  # a third are copies
    rows = [(i, int(r.integers(0, 4)), [float(c) for c in x[i]]) for i in range(900)]
    odd = [(None, 1, rows[0][2]), (1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [float("nan")] + [0.0] * 7), (1300, 2, [None] + [1.0] * 7),
           (1400, 1, [float("inf")] * 8), (1500, 1, []), (1600, 2, [1.0, 0.5]), (1700, 3, [0.0] * 8), (1800, 77, rows[4][2])]
    return rows + odd + rows[:3] + [(100, 2, rows[7][2])]


def test_hard_negatives_equal_brute_force(spark, labelled):
    want = brute_negatives(labelled)
    for sizes in ({}, {"anchor_block": 3, "item_block": 64}):
        got = sorted(map(tuple, H.hard_negatives(vectors(spark, labelled), F.col("vec_id") % 100 == 0, **sizes).collect()))
        assert got == want and len(want) > 100


def test_tree_bounds_spare_scores():
    """Anchors that lie close together: most candidates are ruled out by their parent's score."""
    r = np.random.default_rng(1)
    x = np.floor(100 * r.standard_normal((1, 16)) + 3 * r.standard_normal((40, 16)))
    y = np.floor(100 * r.standard_normal((500, 16)))
    parent, edge = H.spanning_tree(x)
    kind, got = H.Kind(1e4, 16), {}
    top = np.sort(x @ y.T, axis=1)[:, -20]
    n = H.scan_tree(parent, edge, x, y, np.sqrt((y * y).sum(axis=1)), kind, lambda nodes, _: (top[nodes], np.full(len(nodes), np.inf)),
                    lambda node, who, score: got.update({node: {int(w) for w, s in zip(who, score) if s >= top[node]}}))
    assert got == {i: set(np.flatnonzero(x[i] @ y.T >= top[i]).tolist()) for i in range(40)}
    assert n < 0.5 * 40 * 500
    # the tree is a shortest one
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    from itertools import combinations
    root = list(range(40))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    total = 0.0
    for _, a, b in sorted((gap[a, b], a, b) for a, b in combinations(range(40), 2)):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += gap[a, b]
    assert abs(edge.sum() - total) < 1e-6


def test_large_components(spark):
    rows = [(i, i % 2, [float(2 ** (30 + i % 3)), float(i)]) for i in range(0, 20)] + [(100, 0, [1024.0, 3.0])]
    some = [(i, lab, [v[0] / 2 ** 12, v[1]]) for i, lab, v in rows]
    got = sorted(map(tuple, H.hard_negatives(vectors(spark, some), F.col("vec_id") % 100 == 0, low=1).collect()))
    assert got == brute_negatives(some, low=1)
    with pytest.raises(Exception, match="beyond"):
        H.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()


@pytest.mark.parametrize("rows", [[], [(100, 1, [1.0])], [(1, 1, [1.0]), (2, 1, [1.0])], [(100, None, None)],
                                  [(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [1.0]), (103, 2, [0.85]), (104, 2, [0.5])], [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.9])]])
def test_negatives_of_tiny_tables(spark, rows):
    got = sorted(map(tuple, H.hard_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_negatives(rows)


def test_shifted_labels(spark):
    got = {r["vec_id"]: r["label"] for r in H.shifted_labels(vectors(spark, [(7, 9, [1.0]), (14, 3, None), (8, 9, None), (21, None, None), (None, 4, None)])).collect()}
    assert got == {7: 0, 14: 4, 8: 9, 21: None, None: 4}
