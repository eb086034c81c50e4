import random
import struct

import pytest
import xxhash
from helpers import AWKWARD, documents, prose

from lindero.llm.suffixes import cut_text, remove_repeats, repeats


def slow(rows, min_words):
    """Every window of every text."""
    where = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - min_words + 1):
            where.setdefault(tuple(words[s : s + min_words]), set()).add((doc, s))
    marks = {}
    for places in where.values():
        if len(places) > 1:
            for p in places:
                marks.setdefault((p[0], p == min(places)), []).append(p[1])
    out = []
    for (doc, keep), starts in marks.items():
        spans = []
        for s in sorted(starts):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = s + min_words
            else:
                spans.append([s, s + min_words])
        out += [(doc, a, b, keep) for a, b in spans]
    return sorted(out)


def mixed(min_words, seed):
    r = random.Random(seed)
    shared = [prose(seed * 100 + i, min_words * 3 // 2) for i in range(4)]
    rows = []
    for i in range(40):
        parts = []
        for k in range(r.randint(1, 4)):
            parts.append(prose(10_000 * seed + 100 * i + k, r.randint(1, 2 * min_words)))
            p = r.choice(shared).split()
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p))))
            parts.append(" ".join(p[a:b] if r.random() < 0.6 else p))
        rows.append((1000 - i, "  \n".join(parts)))
    rows += [(2000 + i, rows[3][1]) for i in range(5)]  # copies
    rows += [rows[4], rows[11], rows[11]]  # repeated rows are one document
    base = rows[7][1].split()
    for i in range(8):  # near copies
        w = list(base)
        w[(i * 13) % len(w)] = f"edit{i}"
        rows.append((3000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("min_words,gram,seed", [(10, 4, 1), (50, 8, 2), (12, 3, 3), (100, 8, 4), (130, 3, 5), (10, 10, 6)])
def test_equals_brute_force(spark, min_words, gram, seed):
    rows = mixed(min_words, seed)
    got = sorted(tuple(r)[:4] for r in repeats(documents(spark, rows), min_words=min_words, gram=gram).collect())
    assert got == slow(rows, min_words) and any(k for *_, k in got) and not all(k for *_, k in got)


def test_removal(spark):
    passage = prose(77, 70)
    rows = AWKWARD + [(50 + i, f"{prose(i, 30)}\n{passage}\n\n{prose(90 + i, 30)}") for i in range(4)] + [(80, prose(5, 400)), (81, None)]
    docs = documents(spark, rows)
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    want = dict(rows)
    for i in range(1, 4):
        want[50 + i] = f"{prose(i, 30)}\n{prose(90 + i, 30)}"
    want[9] = "word "
    assert got == sorted([(d, want[d] if d else t) for d, t in rows], key=repr)
    spans = repeats(docs).where("doc_id between 50 and 53").collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.keep, r.first_id) for r in spans) == [(50 + i, 30, 100, i == 0, 50) for i in range(4)]


def as_documents(rows):
    """Rows by number in the order of documents, for slow(): one for each id and text."""
    key = lambda x: (x[0] is None, x[0] or 0, text_hash(x[1]))
    return sorted(set(rows), key=key)


def text_hash(text):
    """XXH64 as the engine has it: of whether it is null, then of its bytes with that as the seed."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    first = xxhash.xxh64_intdigest(struct.pack("<I", text is None), 42)
    return signed(first if text is None else xxhash.xxh64_intdigest(text.encode(), first))


def test_rows_that_share_an_id(spark):
    p, fresh = prose(1, 60), prose(2, 300)
    rows = [(1, p + " " + prose(3, 20)), (2, prose(4, 20) + " " + p), (2, "short text here"), (2, fresh), (2, prose(4, 20) + " " + p), (None, p), (None, p + " end"), (3, p), (3, None), (None, None)]
    docs = documents(spark, rows).withColumnsRenamed({"id": "__id", "score": "__spans", "source": "key"})
    numbered = as_documents(rows)
    cut = {}
    for n, a, b, keep in slow([(n, t) for n, (_, t) in enumerate(numbered)], 50):
        if not keep:
            cut.setdefault(n, []).append((a, b))
    want = {row: cut_text((row[1] or "").encode(), cut.get(n, [])).decode() if row[1] is not None else None for n, row in enumerate(numbered)}
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(((i, want[i, t]) for i, t in rows), key=repr)
    assert want[2, fresh] == fresh and want[3, p] == "" and want[None, p + " end"] == "end"


def test_parameters(spark):
    with pytest.raises(ValueError):
        repeats(documents(spark, []), min_words=5, gram=6)


def test_edges(spark):
    assert repeats(documents(spark, [])).count() == 0
    assert remove_repeats(documents(spark, [])).count() == 0
    assert cut_text(b" a  b\tc d ", [(1, 3)]) == b" a  d "
    assert cut_text(b"a b", [(0, 2)]) == b""
    long = [(1, prose(1, 20_000)), (2, prose(2, 100) + " " + prose(1, 20_000))]
    got = sorted(tuple(r)[:4] for r in repeats(documents(spark, long)).collect())
    assert got == slow(long, 50)
