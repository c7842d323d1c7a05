"""The Jaccard join against all pairs."""

import random

from scorecraft.llm.components import components
from scorecraft.llm.jaccard_join import jaccard_classes, keep_one

SCHEMA = "doc_id long, text string, node string, n int"


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    name[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    rows, n = [], 0
    for group in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 30, 80, 200]))]
        if group % 4 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(r.choice([1, 1, 2, 4])):
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                base[r.randrange(len(base))] = r.choice(vocabulary).upper()
    base = [r.choice(vocabulary) for _ in range(120)]  # a large group around the threshold
    for _ in range(150):
        copy = list(base)
        for _ in range(r.choice([1, 2, 3])):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        rows.append((n, " ".join(copy)))
        n += 1
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "one"), (n + 5, "ONE"), (None, "one"), (None, "alone here"),
                   (5, rows[5][1]), (n + 6, "long " * 4000)]


def test_components_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)
        assert sorted(map(tuple, jaccard_classes(docs).collect()), key=repr) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], SCHEMA)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {d for d, n, c in brute(rows) if d is not None and (not n or d == c)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want)
    assert ids.count(None) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_classes(docs).count() == 0 and keep_one(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_reused_and_missing_ids_are_judged_by_their_own_text(spark):
    r = random.Random(11)
    a, b, c, d = ([f"{p}{r.randrange(10 ** 6)}" for _ in range(101)] for p in "abcd")
    near = lambda t: " ".join([*t, "more"])
    rows = [(0, " ".join(a)), (1, near(a)), (1, " ".join(b)), (None, near(b)), (7, " ".join(c)), (7, " ".join(d)), (8, near(c)), (8, near(c)),
            (9, " ".join(d)), (9, "  ".join(d)), (10, near(d)), (10, " ".join(["x", *d])), (None, "lonely row"), (12, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, jaccard_classes(docs).collect()), key=repr) == brute(rows)
    kept = sorted(((x["doc_id"], x["text"]) for x in keep_one(docs).collect()), key=repr)
    assert kept == sorted([(0, " ".join(a)), (1, " ".join(b)), (None, near(b)), (7, " ".join(c)), (7, " ".join(d)), (None, "lonely row"),
                           (12, None), (12, "")], key=repr)


def test_repeated_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text)] * 300 + [(None, text)] * 200 + [(6, text + " z"), (3, text + " y")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, jaccard_classes(docs).collect()), key=repr) == brute(rows)
    assert sorted((x["doc_id"] for x in keep_one(docs).collect()), key=repr) == sorted([3] + [None] * 200, key=repr)
