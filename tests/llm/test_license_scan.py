import re
import tracemalloc
from collections import Counter
from pathlib import Path

import pytest

from orrery.llm import license_scan as L

from .common import SCHEMA, frame, hard_rows, texts


def facts(words):
    versions = set()
    for m in re.finditer(" (?:version|v) ([0-9]{1,3}(?: [0-9]{1,3})?) ", " " + " ".join(words) + " "):
        versions.add(m[1].removesuffix(" 0"))
    return {w for w in words if w.isdigit() and w != "0"}, versions, {w for w in words if w in L.FAMILY}


def brute(text):
    """Every template against every segment."""
    text = text or ""
    big = re.split(L.PARAGRAPH, text) + text.split("\n")
    found = {}
    for s in {text, *big, *(x for b in big for x in re.split(L.SENTENCE, b))}:
        w = [x.decode() for x in L.words_of(s)]
        a = Counter(zip(w, w[1:], strict=False))
        for name, ts in L.TEMPLATES.items():
            for t in ts:
                v = [x.decode() for x in L.words_of(t)]
                b = Counter(zip(v, v[1:], strict=False))
                common = sum((a & b).values())
                if a and 2 * common / (a.total() + b.total()) >= L.THRESHOLD:
                    (n1, v1, f1), (n2, v2, f2) = facts(w), facts(v)
                    if n2 <= n1 and (not v2 or v1 == v2) and f1 == f2:
                        found[name] = max(found.get(name, (0, 0)), (common, 2 * common / (a.total() + b.total())))
    best = min(((-c, -v, k) for k, (c, v) in found.items()), default=None)
    return best and best[2], best and round(-best[1], 9), len(found), ",".join(sorted(found))


def test_against_brute_force(spark, sf):
    mit = L._MIT.replace(", ", ",\n")
    more = [mit, "Intro.\n\n" + mit + "\n \nEnd.", L.TEMPLATES["GPL-3.0"][0].upper(), "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "Released under the MIT", L.TEMPLATES["Apache-2.0"][2].replace("License", "license", 1)]
    more += [f"Some words before it. {t} And after it." for ts in L.TEMPLATES.values() for t in ts]
    rows = hard_rows(texts(spark, sf)[:20] + more)
    got = L.license_scan(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert {"MIT", "GPL-3.0", "CC-BY-NC-4.0", "Apache-2.0", None} <= {r.license_id for r in got}


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(L.TEMPLATES, L.THRESHOLD)


def named(scanner, text):
    found = scanner.scan(text)
    return min(((-c, -v, k) for k, (c, v) in found.items()), default=(0, 0, None))[2]


def test_every_template_finds_its_licence_alone(scanner):
    for name, ts in L.TEMPLATES.items():
        for t in ts:
            assert named(scanner, t) == name
            assert {n for n, *_ in scanner.best(t)} == {name}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (L._gnu("General Public License", "2", "This program"), "GPL-2.0"),
        (L._gnu("Lesser General Public License", "2.1", "This library"), "LGPL-2.1"),
        ("GNU Lesser General Public License, version 2", "LGPL-2.0"),
        ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
        ("Copyright (c) 2020 Jane Doe. All rights reserved.\n\n" + L.TEMPLATES["BSD-2-Clause"][1], "BSD-2-Clause"),
        (L.TEMPLATES["ISC"][0], "ISC"),
        ("Copyright (c) 2020 Jane Doe. Released under the MIT License. See the manual for more of it.", "MIT"),
        ("It is free. Licensed under the\nApache License, Version 2.0. It is\nwithout cost and has more words in its paragraph than the notice.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 2.0.", "GPL-2.0"),
    ],
)
def test_licences_of_one_family_are_told_apart(scanner, text, want):
    assert named(scanner, text) == want


def test_a_notice_counts_once_however_many_segments_show_it(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "Released under the MIT License.\n\nLicensed under CC BY 4.0."), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.license_scan(df).collect()}
    assert [got[i].n_licenses for i in (1, 2, 3)] == [1, 2, 0] and [got[i].licenses for i in (1, 2, 3)] == ["MIT", "CC-BY-4.0,MIT", ""]


WHOLE = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not WHOLE.exists(), reason="no licence texts on this system")
@pytest.mark.parametrize(("file", "want"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause"), ("GFDL-1.3", None)])
def test_whole_licence_texts(scanner, file, want):
    if (WHOLE / file).exists():
        assert named(scanner, (WHOLE / file).read_text()) == want


def test_memory_of_a_long_text(scanner):
    text = "some words of a long text without a notice and of no licence " * 160_000
    tracemalloc.start()
    scanner.scan(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 9_000_000 and peak < 5 * len(text)


def test_no_templates_and_empty_table(spark, sf):
    df = frame(spark, hard_rows(texts(spark, sf)))
    assert L.license_scan(df, templates={}).where("license_id IS NOT NULL").count() == 0
    assert L.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
