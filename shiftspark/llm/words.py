"""Token ids of texts by a table of the distinct words that a task has met, found by hash in the texts' bytes.

Words are cut out of the raw bytes and hashed with numpy. Of the words that the task has not met before, plain ones (Latin letters, then
perhaps marks) are put together from two further tables, one of lower-cased runs of letters and one of marks. New runs are encoded
many at once, as a text of runs: each is one piece to the tokenizer, and the ids that can end a piece tell them apart. All other words
are encoded one by one. Every hit is compared byte by byte with what the table holds; a word whose hash belongs to another one goes
on to its next hash, like a probe in an open table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

import numpy as np

from shiftspark.llm.bpe import encoded, tokenizer
from shiftspark.llm.common import LONG_SPAN, hashed, lowered, mix, ragged, words

#: Runs in one text for the tokenizer.
JOINED = 1024
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[np.frombuffer(b".,;:!?", np.uint8)] = True
#: Second bytes that don't make a letter after 0xC3 (times, divided by) or whose lower case has two code points after 0xC4.
_NO_LETTER = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def equal_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each span of data equals the bytes of `other` from `at` on; other goes on long enough."""
    one, two = (np.ndarray(len(x) + 1, np.dtype("<u8"), np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (data, other))
    masks = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
    same, todo, k = np.ones(len(starts), bool), np.flatnonzero(lengths <= LONG_SPAN), 0
    while len(todo):
        left = lengths[todo] - k
        same[todo] &= ((one[starts[todo] + k] ^ two[at[todo] + k]) & masks[np.minimum(left, 8)]) == 0
        todo, k = todo[left > 8], k + 8
    for i in np.flatnonzero(lengths > LONG_SPAN):
        same[i] = (data[starts[i] : starts[i] + lengths[i]] == other[at[i] : at[i] + lengths[i]]).all()
    return same


def plain_words(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words, one after the other in `own`, are letters of two Latin blocks and then perhaps marks; and the letters' bytes."""
    nxt = np.append(own[1:], np.uint8(0))
    two = (own >= 0xC3) & (own <= 0xC5) & (nxt >= 0x80) & (nxt < 0xC0)
    for lead, second in _NO_LETTER:
        two &= (own != lead) | (nxt != second)
    letter = _LETTER[own] | two
    letter[1:] |= two[:-1]
    ends = np.cumsum(lengths)
    upto_letter, upto_mark = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, _MARK[own]))
    letters, marks = (upto[ends] - upto[ends - lengths] for upto in (upto_letter, upto_mark))
    first = upto_letter[ends - lengths + letters] - upto_letter[ends - lengths]
    return (letters > 0) & (letters + marks == lengths) & (first == letters), letters


@cache
def piece_ends(path: str) -> np.ndarray:
    """For each id whether it ends a piece of text, by the suffix that the model gives to word ends; none without such a suffix."""
    t = tokenizer(path)
    suffix = getattr(t.model, "end_of_word_suffix", None)
    out = np.zeros(max(t.get_vocab().values()) + 1, bool)
    for piece, i in t.get_vocab().items():
        out[i] = bool(suffix) and piece.endswith(suffix)
    return out


def one_by_one(path: str, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all spans of bytes in one array, and how many each has."""
    return encoded(path, [data[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), lengths.tolist())])


def joined(path: str, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for runs of letters, JOINED of them in a text. A text whose ids don't end as many pieces is encoded run by run."""
    # each run with a blank after it
    after = np.cumsum(lengths + 1)
    text = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    text[ragged(after - 1 - lengths, lengths)] = data[ragged(starts, lengths)]
    cuts = [0, *after[JOINED - 1 :: JOINED].tolist()]
    cuts += [len(text)] if cuts[-1] < len(text) else []
    texts = [text[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
    ends, ids, counts = piece_ends(path), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for i, e in enumerate(tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)):
        own = slice(i * JOINED, (i + 1) * JOINED)
        found = np.array(e.ids, np.uint32)
        at = np.flatnonzero(ends[found])
        count = np.diff(at, prepend=-1)
        if len(at) != len(starts[own]) or at[-1] != len(found) - 1:
            found, count = one_by_one(path, data, starts[own], lengths[own])
        ids.append(found)
        counts.append(count)
    return np.concatenate(ids), np.concatenate(counts)


class Table:
    """Distinct spans of bytes with their ids, found by hash; `encode` gives the ids of new ones."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        # by hash: hash and number of a span; by number: place and length of its bytes, place and number of its ids
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes, self.at, self.lengths = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.first, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each span; new spans are added."""
        h, lengths = hashed(data, starts, ends), ends - starts
        number, todo = np.zeros(len(starts), np.int64), np.arange(len(starts))
        while len(todo):
            distinct, first, back = np.unique(h[todo], return_index=True, return_inverse=True)
            place = np.searchsorted(self.hashes, distinct)
            known = np.zeros(len(distinct), bool)
            inside = place < len(self.hashes)
            known[inside] = self.hashes[place[inside]] == distinct[inside]
            if not known.all():
                self._add(data, distinct[~known], starts[todo[first[~known]]], lengths[todo[first[~known]]])
                place = np.searchsorted(self.hashes, distinct)
            number[todo] = self.numbers[place][back]
            same = self.lengths[number[todo]] == lengths[todo]
            own = todo[same]
            same[same] = equal_spans(data, starts[own], lengths[own], self.bytes, self.at[number[own]])
            todo = todo[~same]
            h[todo] = mix(h[todo] + _STEP)
        return self.first[number], self.counts[number]

    def _add(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        before = len(self.at)
        ids, counts = self.encode(data, starts, lengths)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(counts) - counts])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, len(self.bytes) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.bytes = np.concatenate([self.bytes, data[ragged(starts, lengths)]])
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.numbers = both[order], np.concatenate([self.numbers, before + np.arange(len(hashes))])[order]


class WordTable:
    """Ids of texts by tables of distinct words, runs of letters and marks, which grow with the texts; emptied beyond `held` words."""

    def __init__(self, path: str, held: int):
        self.path, self.held = path, held
        self.clear()

    def clear(self) -> None:
        self.words = Table(self._encoded)
        self.runs, self.marks = Table(partial(joined, self.path)), Table(partial(one_by_one, self.path))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each text has."""
        if len(self.words.at) > self.held:
            self.clear()
        starts, ends, doc = words(data, off)
        first, counts = self.words.look(data, starts, ends)
        return self.words.ids[ragged(first, counts)], np.bincount(doc, counts, len(off) - 1).astype(np.int64)

    def _encoded(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words in one array, and how many each has."""
        own, ends = lowered(data[ragged(starts, lengths)]), np.cumsum(lengths)
        plain, letters = plain_words(own, lengths)
        p, o = np.flatnonzero(plain), np.flatnonzero(~plain)
        middle = ends[p] - lengths[p] + letters[p]
        run, in_run = self.runs.look(own, middle - letters[p], middle)
        marked = middle < ends[p]
        mark, in_mark = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        mark[marked], in_mark[marked] = self.marks.look(own, middle[marked], ends[p][marked])
        rest, in_rest = one_by_one(self.path, data, starts[o], lengths[o])
        # runs, marks and other words follow each other; each word takes one or two stretches of them
        flat = np.concatenate([self.runs.ids, self.marks.ids, rest])
        at, n = np.zeros((len(starts), 2), np.int64), np.zeros((len(starts), 2), np.int64)
        at[p], n[p] = np.stack([run, len(self.runs.ids) + mark], 1), np.stack([in_run, in_mark], 1)
        at[o, 0], n[o, 0] = len(flat) - len(rest) + np.cumsum(in_rest) - in_rest, in_rest
        return flat[ragged(at.ravel(), n.ravel())], n.sum(1)
