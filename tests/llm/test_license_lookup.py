"""Licence scans against the same rules in plain Python."""

import re

from surveyloom.llm import license_lookup as ll
from surveyloom.llm.license_texts import FOLDER as FULL
from surveyloom.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def form(text):
    text = re.sub(r"\r\n?", "\n", text.lower())
    for a, b in ll.SPELLINGS:
        text = text.replace(a, b)
    text = re.sub(f"(?m){ll.COPYRIGHT_LINE}", "", text)
    text = re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ", text)
    return [x.strip(" ") for x in text.split("\n")]


def flat(lines):
    return " ".join(x for x in lines if x)


def expected(docs):
    known = {}
    for name, text in ll.KNOWN:
        known.setdefault(flat(form(text)), name)
    out = {}
    for doc_id, text in docs:
        if text is None:
            continue
        lines = form(text)
        units = [("n_whole", next((i for i, x in enumerate(lines, 1) if x), 1), flat(lines))]
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j]:
                j += 1
            if j > i:
                units.append(("n_paragraphs", i + 1, " ".join(lines[i:j])))
            i = max(j, i + 1)
        units += [("n_lines", i, x) for i, x in enumerate(lines, 1)]
        for unit, line, x in units:
            if x and x in known:
                row = out.setdefault((doc_id, known[x]), {"n_whole": 0, "n_paragraphs": 0, "n_lines": 0, "first_line": line})
                row[unit] += 1
                row["first_line"] = min(row["first_line"], line)
    return out


def rows(df):
    return {(r.doc_id, r.license): {k: r[k] for k in ("n_whole", "n_paragraphs", "n_lines", "first_line")} for r in df.collect()}


def test_edge_cases(spark):
    mit = ll.KNOWN[21][1]
    docs = [
        (1, None), (2, ""), (3, " \n\n "), (4, "Released under the MIT Licence!!"), (5, mit.upper()),
        (6, f"Copyright (c) 2020 Someone\nAll rights reserved.\n\n{mit}"), (7, f"# code\n\n{mit[:300]}\n{mit[300:]}\n\nx = 1"),
        (8, "released under the MIT license, more"), (9, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY NC 4.0"),
        (9, "Licensed under CC BY-NC 4.0."), (None, "SPDX-License-Identifier: MIT"), (10, "text\r\nReleased under the MIT License.\r\n"),
        (11, "word " * 50_000 + "\n" + "Released under the MIT License."),
    ]
    # cut between words only
    docs[6] = (7, "# code\n\n" + mit.replace(" The above", "\nThe above") + "\n\nx = 1")
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, license string")
    known = ll.known_digests(spark)
    got = rows(ll.scan_licenses(df, known))
    assert got == expected(docs)
    assert got[(5, "MIT")]["n_whole"] == 1 and got[(6, "MIT")]["n_whole"] == 1 and got[(7, "MIT")]["n_paragraphs"] == 1
    assert (8, "MIT") not in got
    assert ll.scan_licenses(df.limit(0), known).count() == 0
    assert ll.scan_licenses(df, known.limit(0)).count() == 0


def test_query_equals_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = rows(QUERIES["op2_license_scan"](spark, FOLDER))
    assert got == expected(docs) and len(got) > 10


def test_licences_as_they_are_distributed(spark):
    mit = ll.KNOWN[21][1].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    apache = (FULL / "Apache-2.0.txt").read_text()
    header = apache[apache.index("   Licensed under the Apache License") :]
    titled = f"MIT License\n\nCopyright (c) 2020 X\n\n{mit}"
    commented = "\n".join(f"# {x}" for x in titled.split("\n"))
    docs = [
        (1, titled), (2, commented), (3, f"/*\n * Copyright 2020 X\n *\n * {header.strip()}\n */\nint x;"), (4, apache),
        (5, f"Readme\n\n{titled}\n\nmore words"), (6, mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")), (7, f"{mit} more"),
        *[(10 + i, (FULL / f"{n}.txt").read_text()) for i, n in enumerate(("GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"))],
    ]
    got = rows(ll.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), ll.known_digests(spark)))
    whole = {k: v["n_whole"] for k, v in got.items()}
    assert {k for k in whole} >= {(i, "MIT") for i in (1, 2, 5, 6)} | {(3, "Apache-2.0"), (4, "Apache-2.0"), (10, "GPL-2.0"), (11, "GPL-3.0"), (12, "MPL-2.0"), (13, "CC0-1.0")}
    assert all(whole[k] == 1 for k in ((1, "MIT"), (2, "MIT"), (4, "Apache-2.0"), (10, "GPL-2.0"), (11, "GPL-3.0"), (12, "MPL-2.0"), (13, "CC0-1.0")))
    assert got[(5, "MIT")]["n_whole"] == 0 and got[(5, "MIT")]["n_paragraphs"] >= 1 and (7, "MIT") not in got


def test_many_short_paragraphs_take_linear_time(spark):
    """A megabyte of two-word paragraphs, with a licence of three paragraphs among them, and openings without end."""
    mit = ll.KNOWN[21][1].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\n\n THE SOFTWARE IS")
    n = 90_000
    docs = [
        (1, "two words\n\n" * n + mit + "\n\n" + "two words\n\n" * n), (2, "permission\n\n" * n), (3, "\n\n\n" + mit),
        (4, mit + "\n\nsold.\n"), (5, f"\n{mit[:-1]}\nx"), (6, f"{mit}\n\n{mit}"), (7, "MIT License\n\n" * 2000 + mit),
    ]
    got = rows(ll.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), ll.known_digests(spark)))
    one = {"n_whole": 0, "n_paragraphs": 1, "n_lines": 0}
    assert got == {
        (1, "MIT"): one | {"first_line": 2 * n + 1},
        (3, "MIT"): {"n_whole": 1, "n_paragraphs": 0, "n_lines": 0, "first_line": 4},
        (4, "MIT"): one | {"first_line": 1},
        (6, "MIT"): one | {"n_paragraphs": 2, "first_line": 1},
        # with its title and without
        (7, "MIT"): one | {"n_paragraphs": 2, "first_line": 3999},
    }


def test_runs_equal_all_runs_of_paragraphs(spark):
    """Against every run of consecutive paragraphs, with random cuts of known texts."""
    import random

    draw = random.Random(5)
    known = [("A", "one two three four"), ("B", "one two three four one two"), ("C", "three four one two"), ("D", "four one two three four five")]
    digests = ll.known_digests(spark, known)
    docs = []
    for i in range(200):
        words = [w for _ in range(draw.randint(1, 5)) for w in draw.choice(known)[1].split()]
        docs.append((i, "".join(w + draw.choice([" ", " ", "\n", "\n\n", " \n \n\n"]) for w in words)))
    want = {}
    for i, text in docs:
        parts = [" ".join(p.split()) for p in re.split(r"\n[ \n]*\n", text) if p.strip()]
        forms = dict((b, a) for a, b in known)
        for a in range(len(parts)):
            for b in range(a + 2, len(parts) + 1):
                name = forms.get(" ".join(parts[a:b]))
                # a run begins with a paragraph of at least the opening's length or the whole of it
                if name and parts[a][: ll.OPENING] == " ".join(parts[a:b])[: ll.OPENING] and (a, b) != (0, len(parts)):
                    want[(i, name)] = want.get((i, name), 0) + 1
    base = expected_with(docs, forms)
    got = {(r.doc_id, r.license): r.n_paragraphs for r in ll.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), digests).collect()}
    both = {k: base.get(k, 0) + want.get(k, 0) for k in base.keys() | want.keys()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in both.items() if v}
    assert len(want) > 10


def expected_with(docs, forms):
    """Single paragraphs that are known texts."""
    out = {}
    for i, text in docs:
        for p in re.split(r"\n[ \n]*\n", text):
            name = forms.get(" ".join(p.split()))
            if name:
                out[(i, name)] = out.get((i, name), 0) + 1
    return out
