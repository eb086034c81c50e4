"""Byte-level BPE encoding and decoding over a trie of the distinct words.

The encoding of a prefix is its last token and the encoding of what stands before it, and just
one vocabulary entry that ends there is compatible with the last token before. So a walk down the
trie, which keeps the last token at every node, encodes each shared prefix once; a word's tokens
are read back from its node. Two tokens are compatible when no merge across their seam would come
before the merges that made them.

Nulls and edge cases: a null text is empty; an empty text has no tokens, and its hashes are those of
the empty string; equal rows give equal rows; texts may be of any length; special tokens that stand
in a text count as such; ids may be null or repeated and are passed through; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from lindero.llm.common import map_texts
from lindero.llm.trie import LONGEST, Cache, Trie, Vocabulary

#: White space by Unicode's property, as the pattern's \s means it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the published split pattern of byte-level BPE.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """One vocabulary. Inside, tokens are numbered by the order in which merges make them, single bytes first."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        single = [c for c in letters if c in vocab]
        if len(single) != 256:
            raise ValueError("a byte has no token")
        number = {c: i for i, c in enumerate(single)}
        left, right, names = list(range(256)), list(range(256)), list(single)
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(number[a])
            right.append(number[b])
            if a + b in number:
                raise ValueError(f"two merges make {a + b}")
            number[a + b] = len(names)
            names.append(a + b)
        self.left, self.right = np.array(left), np.array(right)
        pairs = (self.left[256:].astype(np.uint64) << np.uint64(32)) | self.right[256:].astype(np.uint64)
        order = np.argsort(pairs)
        self.pairs, self.pair_makes = pairs[order], order + 256
        self.pair_exact = {int(p): i + 256 for i, p in enumerate(pairs)}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._spot(pairs)] = True
        self.bytes = [raw(s) for s in names]
        self.size = np.array([len(b) for b in self.bytes])
        self.text = [str(vocab[s]) for s in names]
        self.vocabulary = Vocabulary({b: i for i, b in enumerate(self.bytes)})
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{_WS}").replace("\\s", f"[{_WS}]").replace("\\S", f"[^{_WS}]"))
        self.known_pair, self.known_ok = np.full(1 << 20, _NONE), np.zeros(1 << 20, bool)

    @staticmethod
    def _spot(pairs: np.ndarray) -> np.ndarray:
        return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The tokens that merges make of pairs; a huge number where there is none."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(a), _NEVER)
        at = np.flatnonzero(self.maybe[self._spot(pair)])
        place = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
        hit = self.pairs[place] == pair[at]
        out[at[hit]] = self.pair_makes[place[hit]]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges on both sides of the seam, latest first; a merge across it that comes before the one undone forbids the pair."""
        ok = np.ones(len(a), bool)
        live, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), _NEVER)
        while len(live):
            bad = self._made(a, b) < limit
            ok[live[bad]] = False
            live, a, b, limit = live[~bad], a[~bad], b[~bad], limit[~bad]
            # The later one is undone; if it is a single byte, the other; if both are, nothing is left to undo.
            by_a = np.where(a > b, a >= 256, (b < 256) & (a >= 256))
            by_b = ~by_a & (b >= 256)
            limit = np.where(by_a, a, b + 1)
            a, b = np.where(by_a, self.right[a], a), np.where(by_b, self.left[b], b)
            go = by_a | by_b
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As _compatible, with a table of pairs seen before."""
        pair = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        spot = self._spot(pair)
        fresh = np.flatnonzero(self.known_pair[spot] != pair)
        out = self.known_ok[spot]
        if len(fresh):
            some, back = np.unique(pair[fresh], return_inverse=True)
            ok = self._compatible((some >> np.uint64(32)).astype(np.int64), (some & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[fresh] = ok[back]
            where = self._spot(some)
            self.known_pair[where], self.known_ok[where] = some, ok
            # Of pairs with one spot the last is kept; its answer must be its own.
            clash = self.known_pair[where] != some
            if clash.any():
                self.known_pair[where[clash]] = _NONE
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens (in merge order) of distinct non-empty words."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted((i for i in range(len(words)) if len(words[i]) <= LONGEST), key=words.__getitem__)
        for i in range(len(words)):
            if len(words[i]) > LONGEST:
                out[i] = self._walk(words[i])
        if not order:
            return out
        trie = Trie([words[i] for i in order])
        last, back = np.full(len(trie.parent), -1), np.zeros(len(trie.parent), np.int64)
        for lo, matches in trie.suffixes(self.vocabulary):
            for at, up, token in matches:
                open_ = last[lo + at] < 0
                at, up, token = at[open_], up[open_], token[open_]
                ok = up == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible(last[up[inner]], token[inner])
                last[lo + at[ok]], back[lo + at[ok]] = token[ok], up[ok]
        node, steps = trie.ends, []
        while node.any():
            steps.append(np.where(node > 0, last[node], -1))
            node = np.where(node > 0, back[node], 0)
        grid = np.array(steps[::-1]).T
        count = (grid >= 0).sum(1)
        for i, row, n in zip(order, grid.tolist(), count.tolist(), strict=True):
            out[i] = row[len(row) - n :]
        return out

    def _walk(self, word: bytes) -> list[int]:
        """A long word alone: the same states along a single path."""
        last, back, exact = [-1] * (len(word) + 1), [0] * (len(word) + 1), self.vocabulary.exact
        for end in range(1, len(word) + 1):
            for n in self.vocabulary.lengths:
                if n > end:
                    break
                token = exact.get(word[end - n : end])
                if token is not None and (n == end or self._fits(last[end - n], token)):
                    last[end], back[end] = token, end - n
                    break
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def _fits(self, a: int, b: int) -> bool:
        limit, left, right = int(_NEVER), self.left, self.right
        while True:
            if self.pair_exact.get(a << 32 | b, int(_NEVER)) < limit:
                return False
            if a >= 256 and (a > b or b < 256):
                limit, a = a, int(right[a])
            elif b >= 256:
                limit, b = b + 1, int(left[b])
            else:
                return True

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, str, bytes]]:
        """For each piece of text: number of tokens, their ids joined by commas, and the bytes that the ids decode to."""
        parts: list[list] = []
        words: dict[bytes, int] = {}
        for piece in pieces:
            own: list = []
            for i, run in enumerate(self.special_split.split(piece) if self.special_split else [piece]):
                own += [(run,)] if i % 2 else [words.setdefault(w.encode(), len(words)) for w in self.split.findall(run)]
            parts.append(own)
        codes = [(len(t), ",".join([self.text[x] for x in t]), b"".join([self.bytes[x] for x in t])) for t in self.encode_words(list(words))]
        got = [[(1, str(self.special[w[0]]), w[0].encode()) if isinstance(w, tuple) else codes[w] for w in own] for own in parts]
        return [(sum(c[0] for c in g), ",".join([c[1] for c in g]), b"".join([c[2] for c in g])) for g in got]


_NEVER = np.int64(1 << 60)
_NONE = np.uint64((1 << 64) - 1)
#: A piece runs from white space to the end of the next word, where no word of the pattern goes on.
_PIECES = re.compile("[ \\n]*[^ \\n]+|[ \\n]+")
_OTHER_SPACE = re.compile("[^\\S \\n]")


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8), and with_ids the ids."""

    def make():
        encoder = Encoder(vocabulary_path)
        known = Cache(lambda pieces: encoder.encode_pieces(pieces))

        def run(texts):
            split = [_PIECES.findall(s) if not _OTHER_SPACE.search(s := t.decode()) else [s] for t in texts]
            long = [len(p) == 1 and len(p[0]) > 1000 for p in split]
            known.fill({w for p, alone in zip(split, long, strict=True) if not alone for w in p})
            count, ids_hash, text_hash, ids = [], [], [], []
            for p, alone in zip(split, long, strict=True):
                codes = encoder.encode_pieces(p) if alone else [known[w] for w in p]
                joined = ",".join([c[1] for c in codes])
                text = b"".join([c[2] for c in codes]).decode("utf-8", "replace").encode()
                count.append(sum([c[0] for c in codes]))
                ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
            return [count, ids_hash, text_hash] + [ids] * with_ids

        return run

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs, [id_col], text_col, schema, make)
