import re

import pytest
import xxhash
from helpers import AWKWARD, documents, prose

from lindero.llm.simhash import fingerprint, near_duplicates


def slow_fingerprint(text):
    """By the definition, word by word and bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def near_copies():
    rows = []
    for g in range(12):
        base = prose(g, 120).split()
        for k in range(6):
            w = list(base)
            if k:
                w[(k * 17) % 120] = f"edit{k}"
            rows.append((1000 - 10 * g - k, " ".join(w)))
    return rows + [(2000 + i, prose(500 + i, 40)) for i in range(60)]


@pytest.mark.parametrize("rows", [AWKWARD, near_copies()], ids=["awkward", "near"])
def test_equals_brute_force(spark, rows):
    got = near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == slow_components(rows)
    assert len({r[2] for r in got}) < len(rows)


def test_long_text_and_blocks():
    text = prose(3, 30_000)
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
