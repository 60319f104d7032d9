"""Language identification by rank-order profiles of character n-grams.

Spark counts the n-grams of all training texts per language; the most frequent PROFILE of them, in order, are the language's profile.
A text's own most frequent n-grams are ranked alike; its distance to a language is the sum of how far each of them is out of place,
with PROFILE for those that the profile lacks. The nearest language wins, ties going to the first in alphabetical order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shiftspark.llm.common import kept, slices

#: n-grams in a profile, and their greatest length.
PROFILE, LENGTH = 300, 3
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 1 << 20
#: Profiles go to every worker; more languages than this are refused.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The n-grams of a text's words in lower case, with one blank around each word, as integers of 21 bits a code point."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = letters()[codes]
    if not good.any():
        return np.zeros(0, np.uint64)
    codes = np.where(good, codes, np.uint32(32)).astype(np.uint64)
    codes = codes[good | np.concatenate([[True], good[:-1]])]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64) if good[0] else np.concatenate([codes, [32]]).astype(np.uint64)
    blank = codes == 32
    inner = np.flatnonzero(~blank)
    out, key = [codes[inner]], codes.copy()
    for n in range(2, LENGTH + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        key = key[:size] | codes[n - 1 :] << np.uint64(21 * (n - 1))
        # no blank inside, and not blanks alone
        fine = ~(blank[:size] & blank[1 : size + 1]) if n == 2 else ~blank[1 : size + 1]
        out.append(key[fine])
    return np.concatenate(out)


def ranked(text: str) -> np.ndarray:
    """The text's most frequent n-grams in order; ties by n-gram."""
    key = np.sort(grams(text))
    if not len(key):
        return key
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.concatenate([at, [len(key)]]))
    return key[at[np.argsort(-n, kind="stable")[:PROFILE]]]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts, added up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (key, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for b in slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                parts = [grams(t) for t in pc.filter(b.column("text"), pa.array(langs == lang)).to_pylist()]
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], key])
                    key, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([held[lang][1], n]), len(key)).astype(np.int64)
                held[lang] = key, n
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from passed_on()
        yield from passed_on()

    found = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame) -> dict[str, np.ndarray]:
    """The profile of each language of docs (lang, text): at most PROFILE n-grams a language, and MOST_LANGUAGES of them."""
    place = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = kept(counts(docs).withColumn("place", place).filter(F.col("place") <= PROFILE).select("lang", "gram", "place"))
    langs = best.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if langs > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = best.toArrow().to_pandas().sort_values(["lang", "place"])
    return {lang: x["gram"].to_numpy().view(np.uint64) for lang, x in rows.groupby("lang")}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.place = np.full((len(self.langs), len(self.known) + 1), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.place[i, np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - distance / greatest distance."""
        own = ranked(text or "")
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[at < len(self.known)] = np.where(self.known[at[at < len(self.known)]] == own[at < len(self.known)], at[at < len(self.known)], len(self.known))
        place = self.place[:, at]
        away = np.where(place < 0, PROFILE, np.abs(place - np.arange(len(own)))).sum(1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (PROFILE * len(own)))


def language_id(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text), by profiles learned from training (lang, text).

    Texts that are null or without a letter get `und` and score 0, as do all if there is nothing to learn from. Training rows
    without a language or text teach nothing. Whole texts count. Rows with equal ids are judged one by one; an empty table gives an
    empty result; other columns are left aside.
    """
    model = Profiles(learned(training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = zip(*map(model.predict, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
