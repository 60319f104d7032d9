"""The table of words against the tokenizer itself: odd words, small tables, hashes that clash."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shiftspark.llm import words as m
from shiftspark.llm.common import raw
from tests.llm.test_operators import PATH

ODD = ["", " ", "İstanbul's", "Straße...", "don't", "x2y", "<|endoftext|>", "a<|startoftext|>b", "naïve,", "καλός", "éa", "×÷", "ÄÖÜ!!", "ĳ Ŀ ſ ŉ", "a.b", ".", "...", "🙂!",
       "ΑΣ", "ﬁn", "İ", "ı", "\x1cq", "WORD word Word wORD,", "q" * 700, "ab" * 400 + "!?", "12 34", "éé", "́a", "ſs", "Ŋ", "ŸŹŻŽ."]


def texts():
    rng = np.random.default_rng(2)
    letters = list("abcdeéßüABZ") + ["ö"]
    pool = ["".join(rng.choice(letters, rng.integers(1, 9))) + str(rng.choice(["", "", ".", ",!", "'s", "7"])) for _ in range(3000)]
    return ODD + [" ".join(rng.choice([*pool, *ODD], 200)) for _ in range(60)]


@pytest.mark.parametrize("clash, held, joined", [(False, 1 << 20, 1024), (False, 50, 7), (True, 1 << 20, 64)])
def test_ids_equal_the_library(monkeypatch, clash, held, joined):
    monkeypatch.setattr(m, "JOINED", joined)
    if clash:
        plain = m.hashed
        monkeypatch.setattr(m, "hashed", lambda *a: plain(*a) % np.uint64(400))
    table, t = m.WordTable(PATH, held), Tokenizer.from_file(PATH)
    rows = texts()
    for a in range(0, len(rows), 13):
        own = rows[a : a + 13]
        ids, counts = table.encode(*raw(pa.array(own, pa.large_string())))
        want = [e.ids for e in t.encode_batch(own, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_texts_that_show_other_pieces_are_encoded_run_by_run(monkeypatch):
    """As with a model without word ends."""
    monkeypatch.setattr(m, "piece_ends", lambda path: np.zeros(1 << 16, bool))
    t = Tokenizer.from_file(PATH)
    ids, counts = m.WordTable(PATH, 100).encode(*raw(pa.array(["some plain words here."], pa.large_string())))
    assert ids.tolist() == t.encode("some plain words here.", add_special_tokens=False).ids


def test_no_text_gives_no_ids():
    ids, counts = m.WordTable(PATH, 100).encode(*raw(pa.array(["", "  "], pa.large_string())))
    assert not len(ids) and counts.tolist() == [0, 0]
