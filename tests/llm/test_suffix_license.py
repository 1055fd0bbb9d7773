import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import license_scan, suffix_dedup

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, h long, th string, source string"


def brute_removed(texts):
    """(n_bytes, n_removed, n_spans, sha) of each text, from all 200-byte strings."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if starts[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, crowded=suffix_dedup.CROWDED, most_hot=suffix_dedup.HOT):
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, crowded=crowded, most_hot=most_hot).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, brute_removed([r[1] for r in rows]))), key=str)
    assert got == want
    return want


def test_suffix_edges(spark):
    a = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700))
    mid = "é" * 90 + a[:300]
    rows = [(1, a, 1, "x", None), (1, a, 1, "x", None), (None, None, None, None, None), (2, "", 0, "", ""), (3, a[100:299], 0, "", ""), (4, "q" + a[250:450] + "z", 0, "", ""), (5, mid + "1", 0, "", ""), (6, "0" + mid, 0, "", ""), (7, "ab" * 400, 0, "", ""), (8, "word " * 100, 0, "", ""), (None, a[:199], 0, "", "")]
    want = check(spark, rows)
    check(spark, rows, 2)
    check(spark, rows, 2, 0)  # more crowded hashes than are broadcast
    assert any(w[2] == 200 for w in want) and any(0 < w[2] < w[1] for w in want)
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    check(spark, [(r.doc_id, r.text, None, None, None) for r in docs])


def test_suffix_crowded_anchors(spark):
    """A line in many contexts: some share 200 bytes around it, by chance or on purpose, most don't."""
    import random

    rng = random.Random(5)
    line = "the very same line of some sixty bytes stands in every text"
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    heads, tails = [rand(160) for _ in range(4)], [rand(220) for _ in range(4)]
    rows = []
    for i in range(60):
        a, b = rng.randrange(160), rng.randrange(220)
        rows.append((i, rand(rng.randrange(80)) + heads[i % 4][160 - a :] + line + tails[i // 4 % 4][:b] + rand(rng.randrange(80)), 0, "", ""))
    for i in range(60, 75):
        rows.append((i, rand(30) + heads[0] + line + tails[0] + rand(30), 0, "", ""))
    for crowded in (1, 3, 10):
        want = check(spark, rows, crowded=crowded)
    assert 0 < sum(w[2] > 0 for w in want) < len(want)


def test_suffix_very_long_text(spark):
    """Eight megabytes of one letter, and of a short period, hold few contexts; other texts share them."""
    n = 8_000_000
    rows = [(1, "a" * n), (2, "b" * 150 + "a" * 230), (3, "xyz" * (n // 3)), (4, "q" + "xyz" * 66 + "q"), (5, "c" * 199)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in (1, 2, 3, 4, 5)] == [(n, n, 1), (380, 230, 1), (n // 3 * 3, n // 3 * 3, 1), (200, 0, 0), (199, 0, 0)]
    rows = list(suffix_dedup.once(b"12345678", ((7, b"12345678", 150 + i, 150, b"a" * 350) for i in range(1000))))
    assert [r[2:4] for r in rows] == [(150, 150), (0, 1349)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=12).map(str.encode), max_size=12), st.integers(0, 6))
def test_deep_shallow_sort(keys, shallow):
    order, lcp = suffix_dedup.deep_shallow_sort(keys, shallow)
    assert [keys[i] for i in order] == sorted(keys) and sorted(order) == list(range(len(keys)))
    assert lcp[1:] == [suffix_dedup.common(keys[a], keys[b]) for a, b in zip(order, order[1:])]


def test_anchors_are_shared():
    import random

    rng = random.Random(3)
    for _ in range(30):
        s = bytes(rng.choice(b"abcd") for _ in range(200))
        a, b = bytes(rng.choice(b"xyz") for _ in range(rng.randrange(300))), bytes(rng.choice(b"uvw") for _ in range(rng.randrange(300)))
        (p, h), (q, g) = suffix_dedup.anchors([a + s, b + s + a])
        assert {(x - len(a), y) for x, y in zip(p.tolist(), h.tolist())} & {(x - len(b), y) for x, y in zip(q.tolist(), g.tolist())}


def brute_license(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for p, label in license_scan.BASE.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def scan_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_votes(text, k=license_scan.K, shift=license_scan.SHIFT, cover=license_scan.COVER):
    """The method's labels and their best share, template by template with plain loops."""
    w, spans = scan_words(text), []
    for name, marked in license_scan.TEMPLATES.items():
        t = re.sub(r"[*\[\]]", "", marked).split()
        whole = [m.split() for m in re.findall(r"\[(.*?)\]", marked)]
        stars = [x[1:] for x in marked.split() if x[0] == "*"]
        hits = {(i - j, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]}
        near = {d: {(e, j) for e, j in hits if abs(e - d) <= shift} for d, _ in hits}
        words = {d: {j + x for _, j in h for x in range(k)} for d, h in near.items()}
        strength = {d: (len(words[d]) / len(t), len(near[d]), -d) for d in near}
        for d, h in near.items():
            if strength[d] < max(strength[e] for e in near if abs(e - d) <= shift) or len(words[d]) / len(t) < cover or len(words[d]) < min(len(t), license_scan.LEAST):
                continue
            held = {tuple(t[j : j + k]) for _, j in h}
            if all(tuple(m[i : i + k]) in held for m in whole for i in range(len(m) - k + 1)) and all(t.index(x) in words[d] for x in stars):
                spans.append((min(e + j for e, j in h), -max(e + j + k - 1 for e, j in h), -len(words[d]), name, len(words[d]) / len(t)))
    best, outer = {}, -1
    for first, last, _, name, share in sorted(spans):
        if -last > outer:
            best[name.split("/")[0]] = max(best.get(name.split("/")[0], 0), share)
        outer = max(outer, -last)
    return set(best), max(best.values(), default=0.0)


#: Real notices and the labels that they must get, base labels aside.
NOTICES = [
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", ""),
    ("licensed under the terms of the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("the terms of the GNU Lesser General Public License, version 3", "lgpl-3.0"),
    ("it comes under the GNU Lesser General Public License", "lgpl"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl-2.1"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "lgpl-3.0"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "agpl-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "agpl-3.0"),
    ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gpl-2.0"),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl-3.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
    ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache-2.0"),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("licensed under the Academic Free License version 2.0", ""),
    ("Released under the MIT License.", "mit"),
    ("MIT License\n\nCopyright (c) 2020 Some Body", "mit"),
    ("The MIT License (MIT)", "mit"),
    ("BSD 3-Clause License\n\nCopyright (c) 2019, Some Body", "bsd"),
    ("BSD 2-Clause License", "bsd"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: MIT-0", "mit-0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "cc-by-nc-sa-4.0"),
    ("SPDX-License-Identifier: CC-BY-4.0", "cc-by-4.0"),
    ("CC0 1.0 Universal", "cc0-1.0"),
    ("Boost Software License - Version 1.0 - August 17th, 2003", "bsl-1.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ""),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Licensed under the Apache License, Version 2.0 or under the MIT License, at your option", "apache-2.0,mit"),
    ("the license of this software is to be decided, all copies and the following conditions are met", ""),
]


def test_notices_get_their_labels_alone(spark):
    rows = [(i, t, 0, "", "") for i, (t, _) in enumerate(NOTICES)]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - set(license_scan.BASE.values()) for r in license_scan.license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    wrong = [(t, want, sorted(got[i])) for i, (t, want) in enumerate(NOTICES) if got[i] != set(filter(None, want.split(",")))]
    assert not wrong, wrong


def test_license_scan(spark):
    import random

    t = license_scan.TEMPLATES
    rows = [(1, "Licensed under CC BY-NC 4.0.", 1, "", ""), (1, "Licensed under CC BY-NC 4.0.", 1, "", ""), (2, None, None, None, None), (3, "ALL RIGHTS RESERVED all rights reserved", 0, "", ""), (None, "this work is licensed, really, under the GNU General Public License version 3", 0, "", ""), (4, "", 0, "", ""), (5, "licensed under the apache licence version 2.0 " + "x " * 9000, 0, "", ""), (6, "ccby cc\nby", 0, "", "")]
    t = {name: re.sub(r"[*\[\]]", "", x) for name, x in t.items()}
    mit = t["mit"].split()
    rows.append((7, " ".join(mit[:9] + ["permission", "is", "hereby", "granted"] + mit[9:]), 0, "", ""))
    rows.append((8, "Licensed under the Apache License, version 2.0; wor\u212a wor\u212a under the MIT license. CC0 1.0 Universal", 0, "", ""))
    rows.append((9, "under the MIT license " * 400 + "é" * 300_000 + " GNU General Public License, version 2", 0, "", ""))
    rng = random.Random(4)
    for i in range(60):
        w = []
        for name in rng.sample(sorted(t), 2):
            part = t[name].split()
            for _ in range(rng.choice([0, 1, 1, 2])):  # insertions, deletions, replacements and stray pieces
                j = rng.randrange(len(part))
                part[j : j + rng.choice([0, 1, 3])] = rng.choice([[], ["zz"], ["of", "the", "software"], ["x"] * 5, part[:4]])
            w += ["word"] * rng.randrange(12) + part
        rows.append((20 + i, " ".join(w), 0, "", ""))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows += [(r.doc_id + 100, r.text, None, None, None) for r in docs]
    got = license_scan.license_scan(spark.createDataFrame(rows, DOCS)).collect()
    want = {r[0]: (brute_license(r[1]), *brute_votes(r[1])) for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        base, method, share = want[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        assert set(filter(None, r.labels.split(","))) == method | set(filter(None, r.base_labels.split(","))), r.doc_id
        assert abs(r.score - (1.0 if r.n_base else share)) < 1e-12
    by = {r.doc_id: r for r in got}
    assert by[1].labels == "cc-by,cc-by-nc-4.0" and by[None].labels == "gpl,gpl-3.0" and by[5].labels == "apache-2.0" and by[2].labels == ""
    assert by[7].labels == "mit" and by[8].labels == "apache-2.0,cc0-1.0,mit" and by[8].n_words == 18 and by[9].labels == "gpl,gpl-2.0,mit"
    assert license_scan.license_scan(spark.createDataFrame([], DOCS)).count() == 0
