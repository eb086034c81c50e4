import os
import zlib

import public_tokenizers
import pytest
from helpers import AWKWARD, documents, prose
from test_models import text
from test_similar import slow_components
from test_suffixes import as_documents, slow
from tokenizers import Tokenizer

import corpus_pipeline
from lindero.llm.suffixes import cut_text


def kept_rows(rows):
    """Of each component of similar texts the row that comes first."""
    rows = as_documents(rows)
    return sorted((rows[n] for n, first in slow_components([(n, t) for n, (_, t) in enumerate(rows)]) if n == first), key=repr)


@pytest.mark.parametrize("rows", [
    [(1, "B"), (5, "A"), (5, "B"), (None, "C"), (None, "B")], [(1, "B"), (None, "B")], [(None, "B"), (None, "B"), (None, "A")], [(2, "A"), (2, "A"), (2, "B"), (7, None), (8, "")],
])
def test_near_duplicates_by_row(spark, rows):
    texts = {x: prose(ord(x), 60) for x in "ABC"} | {"": ""}
    rows = [(i, texts[x] if x is not None else None) for i, x in rows]
    docs = documents(spark, rows).withColumnsRenamed({"id": "row", "score": "__id", "source": "missing"})
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == kept_rows(rows)


@pytest.fixture()
def folder(spark, tmp_path):
    passage = prose(999, 80)
    rows = [(i, text("en", 80, i) + " " + prose(i, 60), "en") for i in range(20, 140)]
    rows += [(i, text("de", 80, i) + " " + prose(i, 60), "de") for i in range(140, 220)]
    rows += [(300 + i, rows[5][1], "en") for i in range(6)] + [(310 + i, f"{prose(i + 700, 50)}\n{passage}\n{prose(i + 800, 50)}", "en") for i in range(5)]
    rows += [(500, "qxz wvk jjpq zzxw kqvx " * 20, None), (501, "Bugün hava çok güzel ve çocuklar bahçede oynuyor, sonra eve dönecekler. " * 4, None)]
    rows += [(400 + i, " ".join(["spam"] * (40 + i)), "en") for i in range(60)]
    rows += [(i, t, "en") for i, t in AWKWARD] + [(None, text("en", 90, 7000) + " " + prose(7000, 60), "en"), (None, rows[5][1], "en")]
    data = [(i, t, lang, "s", len(t or ""), 0.5, "x") for i, t, lang in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, __id double, __spans string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1) for i in range(20, 220)] + [(400 + i, 0) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_stage_by_stage(spark, folder):
    sf_dir, rows = folder
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    schema = sorted((f.name, f.dataType.simpleString()) for f in docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert sorted((f.name, f.dataType.simpleString()) for f in out.schema) == schema
        before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        if name == "language_id":
            assert {1, 2, 3, 13, 500, 501} & after == set() and set(range(20, 220)) <= after
        if name == "quality_filter":
            assert set(range(20, 220)) <= after and not set(range(400, 460)) & after
        if name == "near_duplicates":
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
            assert got == kept_rows([(r.doc_id, r.text) for r in docs.collect()]) and not {300, 301} & after and None in after
        if name == "repeated_passages":
            assert after == before
            rows = as_documents([(r.doc_id, r.text) for r in docs.collect()])
            cut = {}
            for n, a, b, keep in slow([(n, t) for n, (_, t) in enumerate(rows)], 50):
                if not keep:
                    cut.setdefault(n, []).append((a, b))
            for n, (i, t) in enumerate(rows):
                rows[n] = (i, cut_text(t.encode(), cut.get(n, [])).decode())
            assert cut and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(rows, key=repr)
            assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = t.encode(r.text, add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(want, key=repr)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, packed), key=repr)


def test_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(folder[0] + "/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0 if docs.columns[1] == "piece" else True
