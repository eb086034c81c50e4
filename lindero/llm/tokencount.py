"""Token counts under a unigram vocabulary, by dynamic programming that a trie shares between words.

The distinct words of a slice of texts go into a trie. At each node the forward score, the best
sum of piece scores that spells the prefix, follows from the scores of its ancestors; a prefix that
many words share is scored once. The number of pieces on the best path is kept beside it, and a
word's count is read at its end node.

The scores are those of the vocabulary file if it holds a unigram model. A BPE model holds only the
order in which its pieces were made; from it scores are made by Zipf's law, and the counts are then
those of a unigram model over the BPE model's pieces, not the BPE model's own. A byte that no piece
covers is a piece of its own with a score below all others. Of paths with equal scores the one with
fewer pieces counts.

Nulls and edge cases: null, empty and blank texts have no words and no tokens; equal rows give equal
rows; words may be of any length; ids may be null or repeated and are passed through; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import DataFrame

from lindero.llm.common import map_texts
from lindero.llm.trie import LONGEST, Cache, Trie, Vocabulary

#: What a word begins with in the vocabulary.
WORD_START = "▁".encode()


def zipf_scores(pieces: list[bytes]) -> dict[bytes, float]:
    """Log probabilities of pieces that come in order of rank."""
    total = log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return with_bytes({p: -log(r) - total for r, p in enumerate(pieces, 1)})


def with_bytes(scores: dict[bytes, float]) -> dict[bytes, float]:
    """The scores, and single bytes that are no pieces, 10 below the least."""
    low = min(scores.values()) - 10
    return {bytes([b]): low for b in range(256)} | scores


def load_scores(path: str) -> dict[bytes, float]:
    """Scores of the ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces, scores = [model.id_to_piece(i).encode() for i in plain], [model.get_score(i) for i in plain]
    # A BPE model's scores count down in whole numbers.
    if all(s == -i for i, s in enumerate(scores)):
        return zipf_scores(pieces)
    return with_bytes(dict(zip(pieces, scores, strict=True)))


class Counter:
    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.vocabulary = Vocabulary({p: i for i, p in enumerate(scores)})
        self.by_id = np.fromiter(scores.values(), np.float64, len(scores))

    def counts(self, words: list[bytes]) -> list[int]:
        """Pieces on the best path of each distinct word."""
        out = [0] * len(words)
        short = sorted((i for i in range(len(words)) if len(words[i]) <= LONGEST), key=words.__getitem__)
        for i in range(len(words)):
            if len(words[i]) > LONGEST:
                out[i] = self._walk(words[i])
        if short:
            trie = Trie([words[i] for i in short])
            best, count = np.full(len(trie.parent), -np.inf), np.zeros(len(trie.parent), np.int64)
            best[0] = 0.0
            for lo, matches in trie.suffixes(self.vocabulary):
                for at, up, piece in matches:
                    score, n, node = best[up] + self.by_id[piece], count[up] + 1, lo + at
                    better = (score > best[node]) | (score == best[node]) & (n < count[node])
                    best[node[better]], count[node[better]] = score[better], n[better]
            for i, n in zip(short, count[trie.ends].tolist(), strict=True):
                out[i] = n
        return out

    def _walk(self, word: bytes) -> int:
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            found = [(best[end - n] + s, -count[end - n] - 1) for n in self.vocabulary.lengths if n <= end and (s := self.scores.get(word[end - n : end])) is not None]
            score, n = max(found)
            best.append(score)
            count.append(-n)
        return count[-1]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_tokens."""

    def make():
        counter = Counter(load_scores(vocabulary_path))
        known = Cache(lambda words: counter.counts([WORD_START + w for w in words]))

        def run(texts):
            split = [t.split() for t in texts]
            known.fill(set().union(*split))
            return [[len(w) for w in split], [sum([known[x] for x in w]) for w in split]]

        return run

    return map_texts(docs, [id_col], text_col, "n_words long, n_tokens long", make)
