import textwrap

import pytest

from loomwalk.llm import licenses

from .helpers import documents
from .test_licenses import BSD2, MIT, S

PREFIXES = ["", "# ", " * ", "// ", "   ", "REM ", "dnl "]


def wrap(text, prefix, width=78, end="\n"):
    out = [prefix + x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
    return end.join(x.rstrip() for x in out)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_and_commented_texts(spark, end):
    apache = f"{S['ApacheHead']};\n{S['ApacheUse']}.\n{S['ApacheCopy']}."
    texts = [(MIT, "MIT"), (BSD2, "BSD-2-Clause"), (apache, "Apache-2.0"), (f"{S['GPLfree3']}.", "GPL-3.0-or-later")]
    rows, want = [], []
    for t, name in texts:
        for p in PREFIXES:
            for width in (30, 78):
                rows.append((len(rows), "/*\n" + wrap(t, p, width, end) + "\n*/\nint x;\n"))
                want.append(name)
    out = {r.doc_id: r.licenses for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert [out[i] for i in range(len(rows))] == want


def test_line_ends_still_end_a_sentence(spark):
    rows = [(0, "Copyright 2020 Someone\nReleased under the MIT License\nmore text"), (1, "Released under the\n\nMIT License"), (2, "All rights\n * reserved"), (3, "words before released under the\nMIT License")]
    out = {r.doc_id: r.licenses for r in licenses.license_scan(documents(spark, rows)).collect()}
    assert out == {0: "MIT", 1: "", 2: "All-Rights-Reserved", 3: ""}


def test_cues_across_line_ends(spark):
    rows = [(i, f"{p}This work is released into the public\n{p}domain\n") for i, p in enumerate(PREFIXES)]
    assert [r.sentence_ids for r in licenses.license_scan(documents(spark, rows)).collect()] == ["PublicDomain"] * len(rows)
