import math
from collections import Counter

import numpy as np

from gridspark.llm import licenses as L

APACHE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def files(spark, rows):
    return spark.createDataFrame([(k, p, t, "other") for k, (p, t) in enumerate(rows)], "file_id long, path string, text string, license string")


def brute(scanner, text, least):
    """The unit of the most evidence over dense vectors: (licence, cosine, line)."""
    units, block = [], []
    for k, line in enumerate([*(text or "").split("\n"), ""]):
        if L.words(line):
            units.append((k, line))
            block.append((k, line))
        else:
            if len(block) > 1:
                units.append((block[0][0], " ".join(x for _, x in block)))
            block = []
    units.append((0, text or ""))
    best = None
    for k, unit in units:
        names = sorted({*L.VOCABULARY, *L.words(unit)})
        idf = np.array([scanner.idf(L.VOCABULARY[w]) if w in L.VOCABULARY else scanner.unknown for w in names])
        def vec(t):
            c = Counter(L.words(t))
            v = np.array([1 + math.log(c[w]) if c[w] else 0.0 for w in names]) * idf
            return v / (np.linalg.norm(v) or 1)
        for name, templates in L.TEMPLATES.items():
            for t in templates:
                c = round(float(vec(unit) @ vec(t)), 9)
                told = round(c**4 * min(len(L.words(unit)), len(L.words(t))), 6)
                if c >= least and (best is None or (-told, k, name) < best[:3]):
                    best = (-told, k, name, c)
    return best and (best[2], best[3], best[1])


TEXTS = [
    "some words\n" + APACHE + "\nand more text here", GPL + "\nbody body body", "Released under the MIT License.", None, "", "nothing of the kind\nat all",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction\n\nother",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "the " * 3000 + "\n" + APACHE,
]


def test_scan_equals_brute_force(spark):
    df = files(spark, [(f"a/{k}", t) for k, t in enumerate(TEXTS)])
    scanner = L.Scanner(*L.frequencies(df))
    assert scanner.files == len(TEXTS)
    got = {r.file_id: r for r in L.scan(df, scanner=scanner).collect()}
    for k, text in enumerate(TEXTS):
        want = brute(scanner, text, 0.75)
        assert (got[k].license, got[k].line) == ((want[0], want[2]) if want else (None, None)), text
        assert abs(got[k].cosine - (want[1] if want else 0)) < 1e-8
    assert [got[k].license for k in (0, 1, 2, 5, 6)] == ["Apache-2.0", "GPL-3.0", "MIT", None, "MIT"]


def test_nearest_ancestor(spark):
    rows = [
        ("LICENSE", GPL + "\n" + "word " * 99), ("a/b/COPYING.txt", APACHE), ("a/b/c/d/x.py", "code"), ("a/y.py", "code"), ("z.py", "code"), ("a/b/m.py", "Released under the MIT License.\n" + "w " * 99),
        ("a/b2/x.py", "code"), (None, "code"), ("a/b/c/d/x.py", "code"),
    ]
    got = {r.file_id: (r.license, r.inherited_license, r.inherited_from, r.effective_license) for r in L.license_scan(files(spark, rows)).collect()}
    assert got[2] == got[8] == (None, "Apache-2.0", "a/b", "Apache-2.0")
    assert got[3] == got[4] == got[6] == got[7] == (None, "GPL-3.0", "", "GPL-3.0")
    assert got[5] == ("MIT", None, None, "MIT")


def licence_files():
    """Whole licences and notices as they stand in files, and the licence of each."""
    head = "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n"
    bsd = [L._REDISTRIBUTION, L._TWO_CLAUSES, L._THIRD_CLAUSE, L._BSD_AS_IS]
    notice = lambda what, stop, name, version: "# " + L._NOTICE.format(what=what, stop=stop, name=name, version=version).replace(" under ", "\n# under ")
    mit = L.TEMPLATES["MIT"]
    yield "MIT", f"MIT License\n\n{head}{L._GRANT}\n\n{mit[6]}\n\n{L._AS_IS}\n"
    yield "BSD-2-Clause", head + "\n\n".join([bsd[0], bsd[1], bsd[3]])
    yield "BSD-3-Clause", head + "\n\n".join(bsd)
    yield "ISC", "ISC License\n\n" + head + "\n\n".join(L.TEMPLATES["ISC"][2:4])
    for what, stop, name, version, key in (
        ("program", ":", L._GPL, "3", "GPL-3.0"), ("program", ";", L._GPL, "2", "GPL-2.0"), ("library", ";", L._LGPL, "2.1", "LGPL-2.1"),
        ("library", ":", L._LGPL, "3", "LGPL-3.0"), ("program", ":", L._AGPL, "3", "AGPL-3.0"),
    ):
        yield key, notice(what, stop, name, version) + "\n\nimport os\n"
        yield key, "\n\n".join(L.TEMPLATES[key][4:5] + L.TEMPLATES[key][7:8]) + "\nEveryone is permitted to copy and distribute verbatim copies"
    yield "Apache-2.0", "/*\n * " + L.TEMPLATES["Apache-2.0"][3].replace("; ", ";\n * ") + "\n *\n * " + L.TEMPLATES["Apache-2.0"][4] + "\n */\ncode"
    yield "Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions."
    yield "MPL-2.0", "// " + L.TEMPLATES["MPL-2.0"][3].replace("If ", "\n// If ")
    yield "EPL-2.0", L.TEMPLATES["EPL-2.0"][2]
    yield "BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + L.TEMPLATES["BSL-1.0"][2]
    yield "Zlib", head + "\n\n".join(L.TEMPLATES["Zlib"][1:3])
    yield "Unlicense", "\n\n".join(L.TEMPLATES["Unlicense"][1:3])
    yield "CC0-1.0", L.TEMPLATES["CC0-1.0"][2]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        yield f"CC-{kind}-4.0", f"some prose\nLicensed under CC {kind} 4.0.\nmore prose"
    for name in L.TEMPLATES:
        yield name, f"// SPDX-License-Identifier: {name + '-only' if 'GPL' in name else name}\nint x;"


def test_licences_that_are_easily_confused():
    for files in (200, 100_000):
        scanner = L.Scanner(files, np.full(len(L.VOCABULARY), files // 50))
        templates = scanner.prepared()
        for name, text in licence_files():
            got = scanner.scan(text, templates, 0.75)
            assert got[0] == name and not got[5], (name, text, got)
        for text in ("This is not licensed under the MIT License", "Not released under the Apache License, Version 2.0."):
            assert scanner.scan(text, templates, 0.75)[0] is None
        assert scanner.scan(L._REDISTRIBUTION, templates, 0.75)[5]  # two licences begin so


def test_inheritance_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    paths = ["/".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(150)]
    rows = [(k, f"{p}/{rnd.choice(['x', 'y'])}{k}".lstrip("/"), rnd.choice([None, None, "MIT", "GPL-3.0", "ISC"]), rnd.choice([0.8, 0.9]), rnd.random() < 0.3) for k, p in enumerate(paths)]
    rows += [(900, "a/LICENSE", "MIT", 0.9, True), (901, "a/COPYING", "ISC", 0.9, True), (902, "LICENSE", "ISC", 0.9, True), (903, "q/r/s", None, 0.0, False), (904, "q/r/s", None, 0.0, False)]
    rows = [(k, p, lic, c if lic else 0.0, bool(lic) and f) for k, p, lic, c, f in rows]
    for root in (True, False):
        mine = [r for r in rows if root or "/" in r[1]]
        got = {r.file_id: r for r in L.inherit(spark.createDataFrame(mine, "file_id long, path string, license string, cosine double, is_license_file boolean")).collect()}
        for k, path, lic, _, _ in mine:
            at, want = path.rpartition("/")[0], (None, None)
            while lic is None:
                here = sorted((-c, p, x) for _, p, x, c, f in mine if f and p.rpartition("/")[0] == at)
                if here:
                    want = (here[0][2], at)
                if here or not at:
                    break
                at = at.rpartition("/")[0]
            assert (got[k].inherited_license, got[k].inherited_from, got[k].effective_license) == (*want, lic or want[0]), path
        assert len(got) == len(mine)


def test_none(spark):
    assert L.license_scan(files(spark, [])).count() == 0
    assert L.license_scan(files(spark, [("a", "x")])).first().effective_license is None


def test_versions_and_neighbours_are_told_apart():
    as_is = L.TEMPLATES["ISC"][3]
    texts = {
        "Licensed under the EUPL, Version 1.2 or later": "EUPL-1.2",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License": "CC-BY-3.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 2.5 International License": None,
        "Copyright 2019 Jane Doe\nLicensed under the Apache License, Version 2.0": "Apache-2.0",
        "Licensed under the Apache License, Version 1.1": "Apache-1.1",
        "Licensed under the Apache License, Version 3.4": None,
        "Licensed under the GNU General Public License v2.0": "GPL-2.0",
        "Mozilla Public License Version 1.1": "MPL-1.1",
        "Eclipse Public License - v 1.0": "EPL-1.0",
        f"Copyright (c) 2020\n\n{L.TEMPLATES['0BSD'][2]}\n\n{as_is}": "0BSD",
        f"MIT No Attribution\n\nCopyright 2021\n\n{L.TEMPLATES['MIT-0'][2]}\n\n{L._AS_IS}": "MIT-0",
    }
    for files in (200, 100_000):
        scanner = L.Scanner(files, np.full(len(L.VOCABULARY), files // 50))
        templates = scanner.prepared()
        for text, name in texts.items():
            assert scanner.scan(text, templates, 0.75)[0] == name, (text, name, scanner.scan(text, templates, 0.75))
    assert L.versions("v2.0, 3 of 2007, 2.1; Copyright 1999-2020") == {"2", "3", "2.1"}


def test_a_licence_above_ten_thousand_directories(spark):
    rows = [(k, f"src/d{k}/f", None, 0.0, False) for k in range(10_000)] + [(-1, "src/LICENSE", "MIT", 0.9, True), (-2, "src/d7/LICENSE", "ISC", 0.9, True), (-3, "other/x/f", None, 0.0, False)]
    df = spark.createDataFrame(rows, "file_id long, path string, license string, cosine double, is_license_file boolean")
    got = {(r.inherited_license, r.inherited_from): r["count"] for r in L.inherit(df).where("license IS NULL").groupBy("inherited_license", "inherited_from").count().collect()}
    assert got == {("MIT", "src"): 9999, ("ISC", "src/d7"): 1, (None, None): 1}
