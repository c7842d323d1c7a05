"""Licence scan: blocks against brute force, inheritance on random trees, expressions and near misses, odd input."""

import math
import random
import re
from collections import Counter

from scorecraft.llm import licenses as L

SCHEMA = "file_id long, path string, text string, license string, term string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def words(text):
    return [w for w in (t.strip(".+-") for t in re.split(L.TERM, text.lower())) if w]


def brute_blocks(files):
    texts = L._block_templates()
    n = len(files)
    df = Counter(w for _, _, t in files for w in set(words(t or "")))
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for _, ws in texts for w in ws}
    rare = math.log(1 + n) + 1
    out = set()

    def vector(ws):
        v = {w: (1 + math.log(c)) * idf.get(w, rare) for w, c in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    for i, p, t in files:
        if t is None:
            continue
        for name, ws in texts:
            side = vector(ws)
            span = int(L.OPENING[0] * len(ws)) + L.OPENING[1]
            for whole, part in ((True, words(t)), (False, words(t)[:span])):
                if not part or (not whole and len(words(t)) <= span):
                    continue
                score = sum(x * side.get(w, 0) for w, x in vector(part).items())
                if score >= L.BLOCK_COSINE:
                    out.add((i, p, name, round(score, 5), whole))
    return out


def test_blocks_equal_brute_force(spark):
    r = random.Random(4)
    texts = dict(L._block_templates())
    vocab = [w for ws in texts.values() for w in ws]
    files = []
    for i in range(80):
        ws = list(texts[r.choice(sorted(texts))])
        keep = r.choice([1.0, 0.95, 0.8, 0.6])
        ws = [w if r.random() < keep else r.choice(vocab) for w in ws]
        more = [r.choice(vocab) for _ in range(r.choice([0, 0, 5, 400]))]
        files.append((i, f"d{i % 7}/f{i}", " ".join(ws + more)))
    files += [(200, "a", None), (201, "b", ""), (202, None, files[0][2]), (None, "c", files[1][2]), (203, "e", "word " * 20_000)]
    got = {(x["file_id"], x["path"], x["license"], round(x["score"], 5), x["whole"]) for x in L.match_blocks(frame(spark, files)).collect()}
    want = brute_blocks(files)
    assert len(want) > 40
    near = lambda s: {(i, p, n, w) for i, p, n, x, w in s if abs(x - L.BLOCK_COSINE) > 1e-4}
    assert near(got) == near(want)


def test_inheritance_on_random_trees(spark):
    r = random.Random(9)
    dirs = [""]
    for _ in range(60):
        dirs.append((r.choice(dirs) + "/" + r.choice("abc")).lstrip("/"))
    notice = {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
              "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    rows, own = [], {}
    for i in range(400):
        d = r.choice(dirs)
        name = r.choice(sorted(notice)) if r.random() < 0.05 else None
        path = (d + "/" if d else "") + f"f{i}"
        rows.append((i, path, notice[name] if name else r.choice(["code", "", None])))
        if name:
            own.setdefault(d, []).append((i, name))
    got = {x["file_id"]: (x["license"], x["how"], x["license_dir"]) for x in L.scan_licenses(frame(spark, rows)).collect()}
    for i, path, text in rows:
        d = path.rpartition("/")[0]
        if text in notice.values():
            assert got[i][1] == "file" and notice[got[i][0]] == text
            continue
        while d not in own and d:
            d = d.rpartition("/")[0]
        assert got[i] == ((None, None, None) if d not in own else (got[i][0], "inherited", d))
        assert d not in own or got[i][0] in {n for _, n in own[d]}


def test_expressions_near_misses_and_two_licences(spark):
    code = "\n" + "value = 1\n" * 60
    text = {n: (L.package_files("scorecraft.llm") / "license_texts" / f"{n}.txt").read_text() for n in ("MIT", "Apache-2.0", "ISC", "GPL-3.0", "Zlib")}
    rows = [
        (1, "1/a", "# SPDX-License-Identifier: (MIT OR Apache-2.0)" + code),
        (2, "2/a", "/* SPDX-License-Identifier: AGPL-3.0-only */" + code),
        (3, "3/a", "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0" + code),
        (4, "4/a", "# SPDX-License-Identifier: ISC" + code),
        (5, "5/a", text["ISC"]),
        (6, "6/a", text["MIT"] + "\n\n" + text["Apache-2.0"]),
        (7, "7/a", "This program is licensed under the GNU Affero General Public License, version 3." + code),
        (8, "8/a", "This program is not released under the MIT license." + code),
        (9, "9/a", text["GPL-3.0"]),
        (10, "10/a", text["Zlib"]),
        (11, "11/a", L.NOTICES[5][1] + code),
        (12, "12/a", "Released under the MIT License." + code + "Licensed under CC BY 4.0."),
    ]
    got = {r["file_id"]: r for r in L.scan_licenses(frame(spark, rows)).collect()}
    assert {i: (r["license"], r["licenses"]) for i, r in got.items()} == {
        1: ("MIT", ["Apache-2.0", "MIT"]), 2: ("AGPL-3.0", ["AGPL-3.0"]), 3: ("GPL-2.0", ["GPL-2.0"]), 4: ("ISC", ["ISC"]), 5: ("ISC", ["ISC"]),
        6: ("Apache-2.0", ["Apache-2.0", "MIT"]), 7: ("AGPL-3.0", ["AGPL-3.0"]), 8: (None, []), 9: ("GPL-3.0", ["GPL-3.0"]), 10: ("Zlib", ["Zlib"]),
        11: ("AGPL-3.0", ["AGPL-3.0"]), 12: ("CC-BY-4.0", ["CC-BY-4.0", "MIT"])}
    assert got[1]["expression"] == "(MIT OR Apache-2.0)" and got[3]["expression"] == "GPL-2.0-or-later WITH Classpath-exception-2.0"
    assert got[5]["how"] == got[6]["how"] == "file" and got[7]["how"] == "header"


def test_odd_files(spark):
    same = "Released under the MIT License."
    rows = [(1, "a/x", same), (1, "a/x", "nothing"), (1, "a/x", same), (2, None, same), (None, "a/y", None), (3, "", "x"), (4, "a/long", "word " * 30_000)]
    got = sorted(((r["file_id"], r["path"], r["license"], r["how"], r["licenses"]) for r in L.scan_licenses(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, "a/x", "MIT", "file", ["MIT"])] * 3 + [(2, None, "MIT", "file", ["MIT"]), (None, "a/y", "MIT", "inherited", []),
                                                                   (3, "", None, None, []), (4, "a/long", "MIT", "inherited", [])], key=repr)
    assert L.scan_licenses(frame(spark, [])).count() == 0
