import hashlib
import random
import struct
import zlib

import public_tokenizers
from helpers import AWKWARD, documents, prose
from tokenizers import Tokenizer

from lindero.llm.bpe import Encoder, encode_decode
from lindero.llm.packing import SumOfSquares, latin_words, pack, pack_documents
from lindero.llm.tokencount import Counter, load_scores, token_counts

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = AWKWARD + [
    (20, "<|endoftext|>mid<|endoftext|> <|ENDOFTEXT|> <|startoftext|>it's  we'll\n\n  ΣΑΣ İstanbul"), (21, "tab\there  nbsp x　y"),
    (22, "é Å Å ﬁ ǅ" * 40), (25, "a\x01b \x01 \x01\x01 c"), (23, prose(1, 6000)), (24, prose(2, 900)),
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(BYTE)
    want = []
    for doc, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)), ids))
    got = encode_decode(documents(spark, TEXTS), BYTE, with_ids=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert encode_decode(documents(spark, []), BYTE).count() == 0


def test_bpe_on_random_strings():
    t, e, r = Tokenizer.from_file(BYTE), Encoder(BYTE), random.Random(5)
    words = list({"".join(r.choice("abcdeéß 漢'12.,-_　\x1c\n\t 🙂") for _ in range(r.randint(1, 30))) for _ in range(3000)})
    for (_, ids, back), enc in zip(e.encode_pieces(words), t.encode_batch(words, add_special_tokens=False), strict=True):
        assert ids == ",".join(map(str, enc.ids))
        assert back == t.decode(enc.ids, skip_special_tokens=False).encode()


def slow_count(scores, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[end - n][0] + scores[word[end - n : end]], best[end - n][1] - 1) for n in range(1, end + 1) if word[end - n : end] in scores))
    return -best[-1][1]


def test_token_counts_equal_brute_force(spark):
    scores = load_scores(PIECE)
    memo = {}

    def count(w):
        if w not in memo:
            memo[w] = slow_count(scores, "▁".encode() + w) if len(w) < 400 else Counter(scores)._walk("▁".encode() + w)
        return memo[w]

    want = [(doc, len(w := (text or "").encode().split()), sum(map(count, w))) for doc, text in TEXTS]
    got = token_counts(documents(spark, TEXTS), PIECE).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    word = b"abc-" * 24
    assert Counter(scores)._walk(word) == slow_count(scores, word)
    assert token_counts(documents(spark, []), PIECE).count() == 0


def field(number, wire, body):
    """A field of a protocol buffer."""
    size = struct.pack("B", len(body)) if wire == 2 else b""
    return bytes([number << 3 | wire]) + size + body


def unigram_model(scores):
    """A sentencepiece unigram model: pieces with scores, and settings that change no text but mark the starts of words."""
    kinds = {"<unk>": 2, "<s>": 3, "</s>": 3}
    rows = [(p, 0.0) for p in kinds] + list(scores.items())
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([kinds.get(p, 1)]))) for p, s in rows)
    return out + field(2, 2, field(3, 0, b"\1")) + field(3, 2, field(1, 2, b"identity") + b"".join(field(n, 0, b"\1") for n in (3, 4, 5)))


def test_counts_of_a_unigram_model_are_the_library_s(spark, tmp_path):
    import sentencepiece

    r, letters = random.Random(3), "abcdé"
    scores = {x: -6 - r.random() for x in [*letters, "▁"]}
    for _ in range(150):
        n = r.randint(2, 6)
        scores["▁" * (r.random() < 0.4) + "".join(r.choice(letters) for _ in range(n))] = -2 - n - r.random()
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(unigram_model(scores))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [(i, " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 60)))) for i in range(80)]
    got = {r.doc_id: r.n_tokens for r in token_counts(documents(spark, texts), path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in texts}


def slow_pack(sizes, capacity):
    """Each size where the sum of the squared numbers of open bins by gap becomes smallest, the smallest gap of those that tie."""
    gaps, out = [], []
    for n in sizes:
        best = None
        for g in sorted({g for g in gaps if g >= n}):
            after = list(gaps)
            after.remove(g)
            after.append(g - n)
            total = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or total < best[0]:
                best = (total, g)
        if best:
            gaps.remove(best[1])
            gaps.append(best[1] - n)
            out.append(capacity - best[1])
        else:
            gaps.append(capacity - n)
            out.append(0)
    return out, len(gaps)


def test_sum_of_squares_equals_brute_force():
    r = random.Random(4)
    for capacity in (7, 20, 100):
        for falling in (True, False):
            sizes = sorted((r.randint(1, capacity) for _ in range(120)), reverse=falling) if falling else [r.randint(1, capacity) for _ in range(120)]
            bins = SumOfSquares(capacity)
            assert ([bins.add(n)[1] for n in sizes], bins.bins) == slow_pack(sizes, capacity)


def test_packing(spark):
    t, rows = Tokenizer.from_file(WORD), TEXTS + [(100 + i, prose(i, 5 + 37 * i % 400)) for i in range(120)]
    want = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = pack_documents(documents(spark, rows), WORD).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2
    assert pack_documents(documents(spark, []), WORD).count() == 0


def test_rows_without_ids_spread(spark):
    parts = spark.createDataFrame([(None, 0, 0, 10 + i % 50, i) for i in range(400)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(parts, 400, 64, ("doc_id", "piece", "start", "ids_crc32"), shard_rows=50).collect()
    assert len({r.sequence_id >> 40 for r in got}) > 5 and len(got) == 400


def test_latin_words_are_encoded_without_the_rules(spark, tmp_path):
    t, r = Tokenizer.from_file(WORD), random.Random(8)
    words = list({"".join(r.choice("etaoinsréñßöçÿàø") for _ in range(r.randint(1, 14))) for _ in range(2000)})
    encode = latin_words(t)
    assert encode(words) == [struct.pack(f"<{len(x)}I", *x) for x in (t.encode(w, add_special_tokens=False).ids for w in words)] and encode([]) == []
    assert latin_words(Tokenizer.from_file(BYTE)) is None
    t.add_special_tokens(["abc"])
    assert latin_words(t) is None
    tails = ["", ".", ",", "...", "?!", "!!!!", "'s", "'s,", "-", "\u0301", "\u0301.", "\u0338", "1", ".x", "×", "ª"]
    rows = [(i, " ".join(r.choice([w, w.upper(), w.title()]) + r.choice(tails) for w in r.sample(words, 60))) for i in range(60)]
    got = {d: (n, crc) for d, _, _, n, crc, *_ in pack_documents(documents(spark, rows), WORD).collect()}
    t = Tokenizer.from_file(WORD)
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
