"""Interpolated modified Kneser-Ney model of any order: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

Tasks count the words of their texts first and send the counts to shards by the word's hash. Each word gets a number, small for a
frequent word, and the shard's files. Tasks then read the texts again, count the n-grams as such numbers and send them, sorted and
packed, to shards by the hash of all words but the last, bigrams by that of both. A shard's task adds them up, writes the sorted hashes
and counts as files of the shared folder, without the bits that their place implies, and passes on to the shards of the next shorter n-grams what it knows of those: which words they end an n-gram with (each counts
once), and how they are followed (by counts 1, 2, more, and what is beyond three). Bigrams pass the same on to the shards of the words. For scoring,
workers map the files that their words fall into; nothing of the model goes through the driver but a few totals.

The end of a text is a token; its start is a context only. An n-gram that begins with the start of a text has nothing before it and
keeps its plain count, and what lies before the start is no context. Unknown words share the place of one word in the uniform
distribution below the words' continuation distribution.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.bpe import packed, unpacked
from shiftspark.llm.common import hashed, lowered, mix, raw, shared_folder, slices, words

#: Tokens that a task holds before it sends their n-grams on, and words; n-grams and words of a shard, about.
HELD, SHARD_GRAMS = 3 << 20, 1 << 21
#: A word and its blank take so many bytes: an estimate, for the number of shards only.
BYTES_A_WORD = 6
END = np.uint64(0x8E51C62F97B4D03B)
#: Numbers of what is no word of the model: the start of a text, and an unknown word. A shard's words begin at its place FIRST.
START, UNKNOWN, FIRST = np.uint64(0), np.uint64(1), 2


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and its text."""
    data, off = raw(batch.column("text"))
    data = lowered(data)
    start, end, doc = words(data, off)
    h = hashed(data, start, end)
    at = np.searchsorted(doc, np.arange(batch.num_rows), side="right")
    return np.insert(h, at, END), np.insert(doc, at, np.arange(batch.num_rows))


def behind(token: np.ndarray, of: np.ndarray, order: int) -> list[np.ndarray]:
    """Each token's number, last, and those of the order - 1 tokens before it. Before a text there are starts."""
    cols = [token]
    for back in range(1, order):
        before = np.full_like(token, START)
        same = of[back:] == of[:-back]
        before[back:][same] = token[:-back][same]
        cols.insert(0, before)
    return cols


def pair(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(context * np.uint64(0xD6E8FEB86659FD93)) ^ (token * np.uint64(0xA0761D6478BD642F)))


def gram(cols: list[np.ndarray]) -> np.ndarray:
    """A hash of each n-gram; of one word, the word's number."""
    return reduce(pair, cols)


def key(cols: list[np.ndarray], log: int) -> np.ndarray:
    """A hash of each n-gram with its shard in front, which all n-grams have in common that differ in the last of three or more words."""
    if len(cols) < 3:
        return gram(cols)
    context = gram(cols[:-1])
    return context & np.uint64((1 << log) - 1 << 64 - log) | pair(context, cols[-1]) >> np.uint64(log)


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of each value."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values), order[first]]


def cuts(keys: np.ndarray, log: int) -> np.ndarray:
    """Where each of the 2^log shards begins among sorted keys, and the end."""
    return np.searchsorted(keys >> np.uint64(63 - log) >> np.uint64(1), np.arange((1 << log) + 1))


def turned(ids: np.ndarray, log: int) -> np.ndarray:
    """Numbers of words with their shard, the last bits, in front."""
    return ids << np.uint64(63 - log) << np.uint64(1) | ids >> np.uint64(log)


def places(keys: np.ndarray, log: int) -> np.ndarray:
    """A turned number's place in its shard."""
    return keys & np.uint64((1 << 64 - log) - 1)


#: Rows between the shards: words or n-grams with their counts, or what follows an n-gram.
PARTS, GRAMS, FOLLOWED = "shard long, kind long, data binary", 0, 1


def sent(kind: int, keys: np.ndarray, log: int, cols: list[np.ndarray], values: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(shard, kind, data) for each shard that sorted keys fall into."""
    cut = cuts(keys, log)
    return [(int(s), kind, blob([c[cut[s] : cut[s + 1]] for c in cols], [v[cut[s] : cut[s + 1]] for v in values])) for s in np.flatnonzero(np.diff(cut))]


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, kind, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int64()), pa.array(data, pa.binary())], ["shard", "kind", "data"])


def counted_words(docs: DataFrame, log: int) -> DataFrame:
    """(shard, kind, data): packed words with their counts, added up within a task as far as it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def together() -> list[np.ndarray]:
            return summed(*map(np.concatenate, zip(*held)))[:2]

        for b in slices(batches):
            token, _ = tokens(b)
            held.append(summed(token, np.ones(len(token), np.int64))[:2])
            if sum(len(h) for h, _ in held) >= HELD:
                held = [together()]
                if len(held[0][0]) >= HELD // 2:
                    h, n = held.pop()
                    yield as_batch(sent(GRAMS, h, log, [h], [n]))
        if held:
            h, n = together()
            yield as_batch(sent(GRAMS, h, log, [h], [n]))

    return docs.select("text").mapInArrow(run, PARTS)


def counted(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, kind, data): packed n-grams with their counts, added up within a task as far as it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            keys, n, at = summed(key(cols, model.log), np.ones(len(cols[0]), np.int64))
            return as_batch(sent(GRAMS, keys, model.log, [c[at] for c in cols], [n]))

        for b in slices(batches):
            token, of = tokens(b)
            known, at = np.unique(token, return_inverse=True)
            ids = model.numbers(known)
            if (ids == UNKNOWN).any():
                raise ValueError("the training texts differ when they are read again")
            held.append(behind(ids[at], of, model.order))
            if sum(len(cols[0]) for cols in held) >= HELD:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, PARTS)


def blob(cols: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Rows of words and numbers in order of the first two words, which are kept as differences."""
    order = np.lexsort(cols[1::-1])
    cols = [c[order] for c in cols]
    steps = [np.diff(cols[0], prepend=np.uint64(0))]
    if len(cols) > 1:
        steps.append(np.where(steps[0] > 0, cols[1], np.diff(cols[1], prepend=np.uint64(0))))
    parts = [numbers(x) for x in [*steps, *cols[2:], *(v[order] for v in values)]]
    return np.array([len(cols), len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unblob(data: bytes) -> list[np.ndarray]:
    n_cols, n_parts = np.frombuffer(data[:16], "<i8")
    sizes = np.frombuffer(data[16 : 16 + 8 * n_parts], "<i8")
    parts = [of_numbers(data[e - s : e]) for e, s in zip(np.cumsum(sizes) + 16 + 8 * n_parts, sizes)]
    cols, values = parts[:n_cols], [x.view(np.int64) for x in parts[n_cols:]]
    if n_cols > 1:
        first = np.flatnonzero(np.concatenate([[True], cols[0][1:] > 0]))
        sums = np.cumsum(cols[1])
        cols[1] = sums - np.repeat((sums - cols[1])[first], np.diff(first, append=len(sums)))
    cols[0] = np.cumsum(cols[0])
    return [*cols, *values]


def numbers(x: np.ndarray) -> bytes:
    """Whole numbers: the low halves, and the high ones where there are any."""
    x = x.view(np.uint64)
    half = np.uint64(32)
    low, high = packed(x.astype(np.uint32)), packed((x >> half).astype(np.uint32)) if x.max(initial=0) >> half else b""
    return len(low).to_bytes(8, "little") + low + high


def of_numbers(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    x = unpacked(data[8:end]).astype(np.uint64)
    return x + (unpacked(data[end:]).astype(np.uint64) << np.uint64(32)) if end < len(data) else x


def saved(folder: str, name: str, array: np.ndarray) -> None:
    """Writes one array; a task that runs again puts the same file in its place."""
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{folder}/{name}.npy")


#: What is kept of how an n-gram is followed: n-grams after it by their counts 1, 2, more, and the sum of what counts are beyond three.
AFTER = ["n1", "n2", "n3", "beyond"]


def total(after: list[np.ndarray]) -> np.ndarray:
    """The sum of the counts."""
    return after[0] + 2 * after[1] + 3 * after[2] + after[3]


def bits(x: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits, 57 at most, one after the other in bytes: eight of them take `width` bytes."""
    rows = np.zeros((-(-len(x) // 8), 8), np.uint64)
    rows.ravel()[: len(x)] = x
    out = np.zeros((len(rows), width), np.uint8)
    for j in range(8):
        at, shift = divmod(j * width, 8)
        some = (rows[:, j] << np.uint64(shift)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (shift + width + 7) // 8]
        out[:, at : at + some.shape[1]] |= some
    return np.concatenate([out.ravel(), np.zeros(8, np.uint8)])


def of_bits(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The numbers at these places."""
    at8 = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at = at * width
    return at8[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)


def width_of(most: int) -> int:
    return max(1, int(most).bit_length())


def save_keys(folder: str, name: str, keys: np.ndarray, log: int) -> None:
    """A shard's sorted keys: where each of 2^front ranges of them begins, and the bits that neither the shard nor the range has."""
    front = max(len(keys).bit_length() - 4, 8 - log, 0)
    rest = 64 - log - front
    ranges = keys << np.uint64(log) >> np.uint64(63 - front) >> np.uint64(1)
    saved(folder, f"{name}.begin", np.searchsorted(ranges, np.arange((1 << front) + 1)).astype(np.uint32))
    saved(folder, f"{name}.keys", bits(keys & np.uint64((1 << rest) - 1), rest))


def places_of(path: str, keys: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys a shard has, and where it has them."""
    begin, data = mapped(f"{path}.begin.npy"), mapped(f"{path}.keys.npy")
    front = (len(begin) - 1).bit_length() - 1
    rest = 64 - log - front
    ranges = (keys << np.uint64(log) >> np.uint64(63 - front) >> np.uint64(1)).astype(np.int64)
    at, end = begin[ranges].astype(np.int64), begin[ranges + 1].astype(np.int64)
    key, last = keys & np.uint64((1 << rest) - 1), int(begin[-1]) - 1
    step = 1 << int((end - at).max(initial=0)).bit_length() >> 1
    while step:
        to = at + step
        at = np.where((to <= end) & (of_bits(data, rest, np.minimum(to - 1, last)) < key), to, at)
        step >>= 1
    hit = np.flatnonzero((at < end) & (of_bits(data, rest, np.minimum(at, last)) == key))
    return hit, at[hit]


def save_rows(folder: str, name: str, cols: list[np.ndarray]) -> None:
    """Rows of numbers as places in a table of the distinct rows: most n-grams have the same few."""
    code, size = np.zeros(len(cols[0]), np.int64), 1
    for x in cols:
        width = int(x.max(initial=0)) + 1
        if size * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            size = int(code.max(initial=0)) + 1
        code, size = code * width + x, size * width
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    saved(folder, f"{name}.code", bits(code, width_of(len(first) - 1)))
    saved(folder, f"{name}.rows", np.stack([x[first] for x in cols]))


def rows_at(path: str, at: np.ndarray) -> np.ndarray:
    rows = mapped(f"{path}.rows.npy")
    return rows[:, of_bits(mapped(f"{path}.code.npy"), width_of(rows.shape[1] - 1), at)]


def by_count(n: np.ndarray) -> list[np.ndarray]:
    return [(n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64), np.maximum(n - 3, 0)]


def first_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def received(pdf: pd.DataFrame, kind: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unblob, pdf["data"][pdf["kind"] == kind]))]


def merged(pdf: pd.DataFrame, order: int, log: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """A shard's n-grams: hashes, columns of words, counts, and how they are followed."""
    *cols, n = received(pdf, GRAMS)
    keys, n, at = summed(key(cols, log), n)
    follow = [np.zeros(len(keys), np.int64) for _ in AFTER]
    if after := received(pdf, FOLLOWED):
        known, *sums, _ = summed(key(after[:order], log), *after[order:])
        where = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
        assert (keys[where] == known).all()
        for x, some in zip(follow, sums):
            x[where] = some
    return keys, [c[at] for c in cols], n, follow


def store(folder: str, order: int, log: int, shard: int, keys: np.ndarray, n: np.ndarray, after: list[np.ndarray]) -> None:
    if not len(keys):
        return
    save_keys(folder, f"grams{order}-{shard}", keys, log)
    save_rows(folder, f"grams{order}-{shard}", [n, *after])
    saved(folder, f"of{order}-{shard}", np.array(first_counts(n)))


def add_up_words(folder: str, log: int):
    """A shard's words to its files, with numbers by falling counts; back come totals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, _ = summed(*received(pdf, GRAMS))
        order = np.lexsort((h, -n))
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(FIRST, FIRST + len(h))
        shard = int(pdf["shard"].iloc[0])
        save_keys(folder, f"words-{shard}", h, log)
        saved(folder, f"place-{shard}", bits(place, width_of(FIRST + len(h) - 1)))
        falls = np.flatnonzero(np.diff(n[order], prepend=0))
        saved(folder, f"count-{shard}", np.stack([np.append(0, falls + FIRST), np.append(0, n[order][falls])]))
        return pd.DataFrame({"tokens": [n.sum()], "types": [len(h)]})

    return run


def add_up(folder: str, order: int, top: bool, log: int):
    """A shard's n-grams, longer than two words, to its files; back come parts of the next shorter ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, cols, n, after = merged(pdf, order, log)
        # what begins before its text is the shorter n-gram that begins with the start, with its plain count
        short = (cols[0] == START) & (cols[1] == START)
        full = ~short
        store(folder, order, log, int(pdf["shard"].iloc[0]), keys[full], n[full], [] if top else [x[full] for x in after])
        below, n_below, at = summed(key(cols[1:], log), np.where(short, n, 1))
        out = sent(GRAMS, below, log, [c[at] for c in cols[1:]], [n_below])
        known = [c[full] for c in cols[:-1]]
        context, *follow, at = summed(key(known, log), *by_count(n[full]))
        return pd.DataFrame(out + sent(FOLLOWED, context, log, [c[at] for c in known], follow), columns=["shard", "kind", "data"])

    return run


def add_up_pairs(folder: str, top: bool, log: int):
    """A shard's bigrams to its files; back come sums for each word."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, (u, v), n, after = merged(pdf, 2, log)
        store(folder, 2, log, int(pdf["shard"].iloc[0]), keys, n, [] if top else after)
        word, *follow, _ = summed(turned(u, log), *by_count(n))
        out = sent(FOLLOWED, word, log, [places(word, log)], follow)
        word, before, _ = summed(turned(v, log), np.ones(len(v), np.int64))
        return pd.DataFrame(out + sent(GRAMS, word, log, [places(word, log)], [before]), columns=["shard", "kind", "data"])

    return run


def add_up_single(folder: str):
    """What comes before and after a shard's words, by their places, to its files; back come totals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {kind: received(pdf, kind) for kind in (GRAMS, FOLLOWED)}
        size = max(FIRST, *(int(x[0].max()) + 1 for x in found.values() if x))
        cols = [np.zeros(size, np.int64) for _ in ["before", *AFTER]]
        for kind, some in ((GRAMS, cols[:1]), (FOLLOWED, cols[1:])):
            if found[kind]:
                for x, values in zip(some, found[kind][1:]):
                    np.add.at(x, found[kind][0].astype(np.int64), values)
        before = cols[0]
        save_rows(folder, f"single-{int(pdf['shard'].iloc[0])}", cols)
        return pd.DataFrame([[*first_counts(before), (before > 2).sum(), before.sum(), (before > 0).sum()]], columns=SINGLE)

    return run


#: Totals of the words: how many come after 1, 2, 3, 4 and more than two others; the sum of these numbers; the words.
SINGLE = ["b1", "b2", "b3", "b4", "more", "bigrams", "words"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts 0, 1, 2 and above."""
    if min(n1, n2, n3) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(np.clip(k - (k + 1) * y * more / some, 0.01, k) for k, some, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Model:
    """The files of a model, mapped where they are needed, and its totals."""

    def __init__(self, folder: str, order: int, log: int):
        self.folder, self.order, self.log, self.totals = folder, order, log, {}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words by their sorted distinct hashes."""
        out = np.full(len(hashes), UNKNOWN)
        for shard, a, hit, at in self.found("words", hashes):
            most = FIRST + int(mapped(f"{self.folder}/words-{shard}.begin.npy")[-1]) - 1
            place = of_bits(mapped(f"{self.folder}/place-{shard}.npy"), width_of(most), at)
            out[a + hit] = place << np.uint64(self.log) | np.uint64(shard)
        return out

    def found(self, kind: str, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of sorted distinct keys, for each shard: its number, where its keys begin, which of them it has, and where it has them."""
        cut = cuts(keys, self.log)
        for shard in np.flatnonzero(np.diff(cut)):
            path, a = f"{self.folder}/{kind}-{shard}", cut[shard]
            if mapped(f"{path}.begin.npy") is not None:
                yield int(shard), a, *places_of(path, keys[a : cut[shard + 1]], self.log)

    def grams(self, cols: list[np.ndarray]) -> np.ndarray:
        """Counts of n-grams, and how they are followed; zeros where there is none."""
        order = len(cols)
        keys, where = np.unique(key(cols, self.log), return_inverse=True)
        out = np.zeros((1 + (order < self.order) * len(AFTER), len(keys)))
        for shard, a, hit, at in self.found(f"grams{order}", keys):
            out[:, a + hit] = rows_at(f"{self.folder}/grams{order}-{shard}", at)
        return out[:, where]

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        """Of words by their numbers: the count, how many words they come after, and how they are followed; zeros for what is none."""
        keys, where = np.unique(turned(ids, self.log), return_inverse=True)
        cut, out = cuts(keys, self.log), np.zeros((2 + len(AFTER), len(keys)))
        for shard in np.flatnonzero(np.diff(cut)):
            a, b = cut[shard], cut[shard + 1]
            at = places(keys[a:b], self.log).astype(np.int64)
            if (counts := mapped(f"{self.folder}/count-{shard}.npy")) is not None:
                out[0, a:b] = counts[1][np.searchsorted(counts[0], at, side="right") - 1]
            if mapped(f"{self.folder}/single-{shard}.code.npy") is not None:
                out[1:, a:b] = rows_at(f"{self.folder}/single-{shard}", at)
        return out[:, where]

    def score(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        t = self.totals
        hashes, of = tokens(batch)
        known, at = np.unique(hashes, return_inverse=True)
        cols = behind(self.numbers(known)[at], of, self.order)
        ids, at = np.unique(np.concatenate(cols[-2:]), return_inverse=True)
        count, before, *single = self.of_words(ids)
        below = np.array(t["below"])
        lower = np.where(before > 0, (before - below[np.minimum(before, 3).astype(int)]) / max(1, t["bigrams"]) + t["unknown"], t["unknown"])
        u, v = at[: len(of)], at[len(of) :]
        p, count = lower[v], count[v]
        for k in range(2, self.order + 1):
            cut = np.array(t["discounts"][k - 2])
            after = [x[u] for x in single] if k == 2 else self.grams(cols[-k:-1])[1:]
            mass, all_after = sum(c * x for c, x in zip(cut[1:], after)), total(after)
            n = self.grams(cols[-k:])[0]
            p = np.where(all_after > 0, (n - cut[np.minimum(n, 3).astype(int)] + mass * p) / np.maximum(all_after, 1), p)
        add = lambda x: np.bincount(of, x, batch.num_rows)
        return {
            "n_tokens": np.bincount(of, minlength=batch.num_rows).astype(np.int64),
            "n_known": add(count > 0).astype(np.int64),
            "train_tokens": np.full(batch.num_rows, t["tokens"], np.int64),
            "base_score": add(np.log10((count + 1) / (t["tokens"] + t["types"] + 1))),
            "score": add(np.log10(p)),
        }


@cache
def mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def log2_shards(rows: float, each: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, rows / each)))))


def learned(docs: DataFrame, order: int) -> Model:
    """The model of all texts of docs (text)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    folder = shared_folder(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(folder, order, log := log2_shards(size / BYTES_A_WORD, SHARD_GRAMS))

    def totals(rows: DataFrame) -> dict[str, int]:
        return {name: x or 0 for name, x in rows.agg(*(F.sum(c).alias(c) for c in rows.columns)).first().asDict().items()}

    t = totals(counted_words(docs, log).groupBy("shard").applyInPandas(add_up_words(folder, log), "tokens long, types long"))
    parts = counted(docs, model)
    for k in range(order, 2, -1):
        parts = parts.groupBy("shard").applyInPandas(add_up(folder, k, k == order, log), PARTS)
    parts = parts.groupBy("shard").applyInPandas(add_up_pairs(folder, order == 2, log), PARTS)
    t |= totals(parts.groupBy("shard").applyInPandas(add_up_single(folder), ", ".join(f"{c} long" for c in SINGLE)))
    if t["words"] != t["types"]:
        raise ValueError("the training texts differ when they are read again")
    below = discounts(t["b1"], t["b2"], t["b3"], t["b4"])
    mass = (below[1] * t["b1"] + below[2] * t["b2"] + below[3] * t["more"]) / max(1, t["bigrams"])
    model.totals = {
        "tokens": t["tokens"],
        "types": t["types"],
        "bigrams": t["bigrams"],
        "unknown": mass / (t["types"] + 1) if t["bigrams"] else 1.0,
        "below": below.tolist(),
        "discounts": [discounts(*of_counts(folder, k, log)).tolist() for k in range(2, order + 1)],
    }
    return model


def of_counts(folder: str, order: int, log: int) -> list[int]:
    """How many n-grams have the counts 1 to 4."""
    paths = (f"{folder}/of{order}-{shard}.npy" for shard in range(1 << log))
    found = [np.load(path) for path in paths if os.path.exists(path)]
    return [int(x) for x in sum(found, np.zeros(4, np.int64))]


def language_model_scores(docs: DataFrame, training: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text), by a model of training (text).

    The model looks at order - 1 tokens before each. Tokens: words with A-Z lowered, then one end. score: log10 probability by the model; base_score: by single tokens with add-one
    counts. A null or empty text is the end alone. Without training texts every token is unknown and has probability 1. Repeated rows
    count and are scored one by one; other columns are left aside; an empty table gives an empty result.
    """
    model = learned(training.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), order)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model.score(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(found[n]) for n in names)], ["doc_id", *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
