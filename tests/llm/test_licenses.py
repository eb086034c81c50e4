import os
import re
import textwrap

import duckdb
from helpers import AWKWARD, documents

from lindero.llm.licenses import NOTICES, WINDOW, bigrams, scan, scan_sql

def wrapped(notice, lead, width=72):
    return "\n".join(lead + x for x in textwrap.wrap(notice, width))


LONG = {"MIT": max((n for i, n in NOTICES if i == "MIT"), key=len), "BSD-3-Clause": max((n for i, n in NOTICES if i == "BSD-3-Clause"), key=len), "GPL-3.0": next(n for i, n in NOTICES if i == "GPL-3.0" and "either version" in n)}
TEXTS = AWKWARD + [(100 + i, f"Some prose here. {n[1]} More prose\nfollows.") for i, n in enumerate(NOTICES)] + [
    (200, "released under the\n mit license"), (201, "RELEASED UNDER THE MIT LICENSE!!\nReleased under the MIT license."),
    (202, "Licensed under CC BY NC 4.0\n\nLicensed under the Apache License"), (203, "Not licensed at all, under no license."),
    (204, "A file.\n\n" + LONG["MIT"].replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS") + "\n\nAnd more prose."),
    (205, "/*\n" + wrapped(LONG["GPL-3.0"], " * ") + "\n */"), (206, "Some prose that goes on. " + wrapped(LONG["GPL-3.0"], "") + " and ends in the same paragraph."),
    (207, "Copyright 2020 Somebody\n\n" + wrapped(LONG["BSD-3-Clause"], "# ")), (208, "\n\n".join(wrapped(n, "") for _, n in NOTICES[:20])), (None, NOTICES[0][1]), (None, NOTICES[5][1]),
]


def slow_scan(rows, threshold=0.8):
    """Every segment against every notice."""
    out, seen = {}, set()
    space = "[ \t\r\n]"
    cut = lambda x: re.sub(f"([.!?]){space}+", "\\1\n", x).split("\n")
    for doc, text in rows:
        if text is None:
            continue
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        paragraphs = re.split(f"\n{space}*\n", low)
        parts = {*cut(low), *low.split("\n"), *(x for p in paragraphs for x in cut(p.replace("\n", " ")))}
        parts |= {" ".join(paragraphs[i : i + w]) for w in range(1, WINDOW + 1) for i in range(len(paragraphs) - w + 1)}
        for part in parts:
            w = [x for x in re.sub("[^a-z0-9]+", " ", part).strip(" ").split(" ")]
            grams = frozenset(f"{a} {b}" for a, b in zip(w, w[1:]))
            if not grams or (doc, grams) in seen:
                continue
            seen.add((doc, grams))
            found = [(2.0 * len(grams & wanted) / (len(grams) + len(wanted)), name) for name, wanted in WANTED]
            top = max(d for d, _ in found)
            for name in {n for d, n in found if d == top and d >= threshold}:
                best, n = out.get((doc, name), (0, 0))
                out[doc, name] = (max(best, top), n + 1)
    return sorted(((d, n, b, s) for (d, n), (b, s) in out.items()), key=repr)


WANTED = [(name, frozenset(bigrams(notice))) for name, notice in NOTICES]


def test_equals_brute_force_and_sql(spark, tmp_path):
    docs = documents(spark, TEXTS)
    got = sorted(map(tuple, scan(docs).collect()), key=repr)
    assert got == slow_scan(TEXTS)
    assert {n for _, n, _, _ in got} == {n for n, _ in NOTICES}
    best = {}
    for doc, name, dice, _ in got:
        best[doc] = max(best.get(doc, (0, "")), (dice, name))
    assert {d: n for d, (_, n) in best.items() if d and 203 < d < 208} == {204: "MIT", 205: "GPL-3.0", 206: "GPL-3.0", 207: "BSD-3-Clause"}
    assert best[204][0] == 1.0 and best[205][0] == 1.0 and best[207][0] > 0.95
    docs.write.parquet(path := str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{os.path.join(path, '*.parquet')}')")
    assert sorted(con.execute(scan_sql()).fetchall(), key=repr) == got


def test_native_and_empty(spark):
    df = scan(documents(spark, []))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
