"""Language identification of mixed-language text.

A text's words are runs of letters of one script. Script ranges leave as candidates for a word the
languages that use its script. Each candidate scores the word by its letters' log probabilities,
given the letters beside them, as counted over all labelled training texts. The best sequence of
languages, where each switch costs a penalty, labels spans of the text.

Nulls and edge cases: a null text, an empty one and one without a letter is `und` with score 0 and no
span; so is every text where nothing is learned; of more languages than MOST_LANGUAGES those with the most
letters are learned, ties by name; texts with a null language are predicted but never
learned from; a word whose script no language was seen in has all of them as candidates; ties go to
the language that sorts first; equal texts get equal results; texts may be of any length; ids may be
null or repeated; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lindero.llm.common import bounded_batches, drop_tables, map_texts, slices, utf8, written_table

#: Rows of the table of counts, and languages that are learned at most, those with the most letters; together they bound the model's size.
BUCKETS, MOST_LANGUAGES = 1 << 16, 128
#: Languages that a task counts at a time.
_HELD = 32
#: What a change of language costs, in nats.
SWITCH = 12.0
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
#: Score of a language that is no candidate.
_OUT = -60.0

#: First and last code points of scripts' main ranges in Unicode.
SCRIPTS = [
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F),
    ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF),
    ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF),
    ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF),
    ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF), ("Ethiopic", 0x1200, 0x139F),
    ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x3134F),
]
_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (0 if it is no letter) and its script."""
    letter, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if chr(i).isalpha():
            low = chr(i).lower()
            letter[i] = ord(low) if len(low) == 1 else i
    for name, a, b in SCRIPTS:
        script[a : b + 1] = _NAMES.index(name)
    script[letter == 0] = 255
    return letter, script


class Words:
    """The words of some texts: buckets and scripts of letters, and where words and texts begin."""

    def __init__(self, texts: list[bytes]):
        letter, script = _tables()
        points = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").decode().encode("utf-32-le"), np.uint32)
        low, kind = letter[points], script[points]
        ends = np.fromiter((len(t) if t.isascii() else len(t.decode()) for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[1], 1 + np.cumsum(ends + 1)])
        at = np.flatnonzero(low)
        here, before, after = low[at].astype(np.uint64), low[at - 1].astype(np.uint64), low[at + 1].astype(np.uint64)
        mixed = here * np.uint64(0x9E3779B97F4A7C15) + before * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
        self.bucket = (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
        self.script = kind[at]
        self.word_at = np.flatnonzero(kind[at] != kind[at - 1])  # among the letters
        self.letters = np.diff(np.append(self.word_at, len(at)))
        self.first, self.last = at[self.word_at], at[self.word_at + self.letters - 1]
        self.text = np.searchsorted(self.text_at, self.first, "right") - 1

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.text, np.arange(len(self.text_at)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> dict:
    """Counts over every text that has one of the most_languages languages with the most letters. The result is bounded: BUCKETS numbers for each."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def counted():
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for a, b in slices([len(t) for t in texts]):
                names = sorted(set(langs[a:b]))
                number = np.fromiter((names.index(x) for x in langs[a:b]), np.int64, b - a)
                words = Words(texts[a:b])
                of = np.repeat(number[words.text], words.letters)
                for i, name in enumerate(names):
                    own = of == i
                    n = held.setdefault(name, np.zeros(BUCKETS + 256, np.int64))
                    n[:BUCKETS] += np.bincount(words.bucket[own], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(words.script[own], minlength=256)
                    if len(held) > _HELD:
                        yield from counted()
        yield from counted()

    rows = src.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = written_table(rows)
    # Scripts' counts stand for the letters of a language, each of which has one.
    most = rows.where(F.col("bucket") >= BUCKETS).groupBy("lang").agg(F.sum("n").alias("letters")).orderBy(F.desc("letters"), "lang").limit(most_languages)
    counted_rows, rows = rows, rows.join(F.broadcast(most), "lang", "left_semi").toPandas()  # most_languages names
    drop_tables(counted_rows)
    langs = sorted(rows.lang.unique())
    counts = np.zeros((len(langs), BUCKETS + 256))
    counts[np.searchsorted(np.array(langs, object), rows.lang.to_numpy(object)), rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(float)
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    log_p = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    uses[:, ~uses.any(0)] = True
    # What a language's own letters have on average: a text that fits far worse is of no language learned.
    usual = (grams * log_p).sum(1) / np.maximum(grams.sum(1), 1)
    return {"langs": langs, "log_p": np.ascontiguousarray(log_p.T, np.float32), "uses": np.ascontiguousarray(uses.T), "usual": usual}


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; starts: where each text's words begin, and the end.

    Texts in which no stretch of words favours other languages than the overall best one by more
    than a switch costs stay whole. For the others the steps of all texts are taken together.
    """
    size, total = np.diff(starts), len(scores)
    out = np.zeros(total, np.int64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    top = np.add.reduceat(scores, starts[some], axis=0, dtype=np.float64).argmax(1)
    own = np.repeat(top, size[some])
    out[:] = own
    others = scores.copy()
    others[np.arange(total), own] = -np.inf
    if scores.shape[1] == 1:
        return out
    gain = others.max(1).astype(np.float64) - scores[np.arange(total), own]
    sums = np.cumsum(gain) - 1e9 * np.repeat(np.arange(len(some)), size[some])  # a text's sums lie below those of texts before
    before = np.concatenate([[0.0], sums[:-1]])
    before[starts[some][1:]] -= 1e9
    rise = np.maximum.reduceat(sums - np.minimum.accumulate(before), starts[some])
    mixed = some[rise > switch - 1e-3]
    mixed = mixed[np.argsort(-size[mixed], kind="stable")]
    if not len(mixed):
        return out
    at, n = starts[mixed], size[mixed]
    live = [int((n > t).sum()) for t in range(int(n[0]))]
    best = scores[at].astype(np.float64)
    came = np.zeros((int(n.sum()), scores.shape[1]), np.int16)
    base = np.concatenate([[0], np.cumsum(n)[:-1]])
    for t in range(1, int(n[0])):
        k = live[t]
        state = best[:k]
        lead = state.argmax(1)
        jump = state[np.arange(k), lead] - switch
        stay = state >= jump[:, None]
        came[base[:k] + t] = np.where(stay, np.arange(scores.shape[1]), lead[:, None])
        best[:k] = np.maximum(state, jump[:, None]) + scores[at[:k] + t]
    label = best.argmax(1)
    for t in range(int(n[0]) - 1, -1, -1):
        k = live[t]
        out[at[:k] + t] = label[:k]
        if t:
            label[:k] = came[base[:k] + t, label[:k]]
    return out


def label(texts: list[bytes], model: dict, with_spans: bool = False, with_fit: bool = False) -> list:
    """lang_pred and score of each text, with_spans the spans' starts, ends (in characters) and languages, and with_fit the fit."""
    langs, size = model["langs"], len(texts)
    words = Words(texts)
    pred, score, fit = ["und"] * size, np.zeros(size), np.full(size, np.nan)
    spans: list = [[[] for _ in range(size)] for _ in range(3)]
    if len(words.text) and langs:
        scores = np.add.reduceat(model["log_p"][words.bucket], words.word_at, axis=0)
        scores[~model["uses"][words.script[words.word_at]]] += _OUT
        starts = words.bounds()
        chosen = viterbi(scores, starts)
        share = np.zeros((size, len(langs)))
        np.add.at(share, (words.text, chosen), words.letters)
        top = share.argmax(1)
        mine = chosen == top[words.text]
        sums = np.zeros((size, len(langs)))
        np.add.at(sums, words.text[mine], scores[mine])
        # How likely the language is, given the words that it has, times its share of the letters.
        surer = 1 / np.exp(np.minimum(sums - sums[np.arange(size), top][:, None], 0)).sum(1)
        full = np.flatnonzero(np.diff(starts))
        score[full] = surer[full] * share[full, top[full]] / share[full].sum(1)
        fit[full] = sums[full, top[full]] / np.maximum(share[full, top[full]], 1) - model["usual"][top[full]]
        for i in full.tolist():
            pred[i] = langs[top[i]]
        if with_spans:
            new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(words.text) != 0)]))
            stop = np.append(new[1:], len(chosen)) - 1
            for i, a, b, x in zip(words.text[new].tolist(), words.first[new].tolist(), words.last[stop].tolist(), chosen[new].tolist(), strict=True):
                origin = int(words.text_at[i])
                spans[0][i].append(a - origin)
                spans[1][i].append(b + 1 - origin)
                spans[2][i].append(langs[x])
    return [pred, score] + spans * with_spans + [fit] * with_fit


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", with_spans: bool = False, with_fit: bool = False) -> DataFrame:
    """The columns kept with lang_pred, score, with_spans span_start, span_end and span_lang, and with_fit fit.

    fit is how much likelier a letter of the language's words is than it is usual for the language, in nats: near 0 for
    its texts, far below for what is in no language that was learned; NaN without a letter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers of 4 bytes for each language

    def make():
        return lambda texts: label(texts, sent.value, with_spans, with_fit)

    schema = "lang_pred string, score double" + ", span_start array<int>, span_end array<int>, span_lang array<string>" * with_spans + ", fit double" * with_fit
    return map_texts(docs, keep, text_col, schema, make)
