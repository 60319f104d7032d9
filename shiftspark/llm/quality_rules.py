"""Quality rules with thresholds that each language and source sets for itself.

Six shares are measured on every whole text. Their quantile sketches are histograms of WIDTH equal cells over [0, 1]: counts per
cell, which merge by addition and give every quantile within 1 / WIDTH. Spark counts the cells per language and source, and merges
them upwards to sketches of the language and of everything, for groups with too few texts of their own. Texts that the base rules
fail are in no sketch.

A text fails if a share lies far above the bulk of its group: over the 75th percentile + FENCE * max(75th - 25th percentile, FLOOR).
Junk that makes up less than a quarter of the other texts of a group moves the limits little. FLOOR only says what difference is too
small to tell apart. A few repeated lines or words are no share of a short text: ALLOWED of them do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from shiftspark.llm.common import hashed, kept, mix, raw, slices, spans, windows, words

#: Cells of a sketch over [0, 1].
WIDTH = 1024
#: Texts that a group needs for thresholds of its own.
LEAST_TEXTS = 50
#: The fence in spreads, and the least spread in cells, for all shares alike.
FENCE, FLOOR = 4, 8
#: Share: numerator, denominator.
SHARES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "echoes": ("n_echoes", "n_words"),
}
#: What does not count: one line that comes twice, and the words of a line of 16 that does.
ALLOWED = {"repeats": 32, "dup_lines": 1}
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATS = 20, 8, 30
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_echoes"]


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_BLANK = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
_SYMBOL, _UPPER, _MARK = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"!?")


def measured(docs: DataFrame) -> DataFrame:
    """Measures of each text, beside its doc_id, lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = b.num_rows
            data, off = raw(b.column("text"))
            start, end, doc = words(data, off)
            count = lambda where: np.bincount(where, minlength=n)
            at = lambda mask: count(np.searchsorted(off, np.flatnonzero(mask), side="right") - 1)
            in_word = ~_BLANK[data]
            chars = at(in_word & ((data & 0xC0) != 0x80))

            h = hashed(data, start, end)
            echo = count(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
            grams, whole = windows(h, doc, REPEAT_WINDOW)
            first = np.flatnonzero(whole)
            key = mix(grams[first] ^ mix(doc[first].astype(np.uint64) + np.uint64(1)))
            twice = repeated(key)
            edge = np.zeros(len(start) + REPEAT_WINDOW + 1, np.int64)
            np.add.at(edge, first[twice], 1)
            np.add.at(edge, first[twice] + REPEAT_WINDOW, -1)
            repeat = count(doc[np.cumsum(edge)[: len(start)] > 0])

            l_start, l_end, l_doc = spans(data != 10, off)
            has_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
            l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
            lines = mix(hashed(data, l_start, l_end) ^ mix(l_doc.astype(np.uint64) + np.uint64(1)))
            later = np.ones(len(lines), bool)
            later[np.unique(lines, return_index=True)[1]] = False
            out = [count(doc), chars, at(_SYMBOL[data]), count(l_doc[later]), repeat, count(l_doc), at(_UPPER[data]), at(_MARK[data]), echo]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x.astype(np.int64)) for x in out], ["doc_id", "lang", "source", *MEASURES])

    return docs.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def cell(share: str) -> F.Column:
    over, under = SHARES[share]
    return F.least(F.lit(WIDTH), F.expr(f"greatest({over} - {ALLOWED.get(share, 0)}, 0) * {WIDTH} div greatest({under}, 1)")).cast("int")


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, a limit for each share) for every language and source of rows; nulls are a group like any other."""
    measures = F.explode(F.map_from_arrays(F.array(*map(F.lit, SHARES)), F.array(*map(cell, SHARES)))).alias("share", "cell")
    sketch = kept(rows.select("lang", "source", measures).groupBy("lang", "source", "share", "cell").agg(F.count("*").alias("n")))
    by_lang = sketch.groupBy("lang", "share", "cell").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("share", "cell").agg(F.sum("n").alias("n"))

    def limits(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        group = W.Window.partitionBy(*keys, "share")
        df = df.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("all", F.sum("n").over(group))
        at = lambda num, den: F.min(F.when(F.col("upto") * den >= F.col("all") * num, F.col("cell")))
        df = df.groupBy(*keys, "share").agg(at(3, 4).alias("high"), at(1, 4).alias("low"), F.first("all").alias("texts"))
        df = df.withColumn("limit", F.col("high") + FENCE * F.greatest(F.col("high") - F.col("low"), F.lit(FLOOR)))
        return df.select(*keys, "share", F.col("limit").alias(name), F.col("texts").alias(f"{name}_texts"))

    own = limits(sketch, ["lang", "source"], "own")
    up = limits(by_lang, ["lang"], "up").select(F.col("lang").alias("up_lang"), F.col("share").alias("up_share"), "up", "up_texts")
    top = limits(overall, [], "top").select(F.col("share").alias("top_share"), "top")
    own = own.join(up, F.col("lang").eqNullSafe(F.col("up_lang")) & (F.col("share") == F.col("up_share"))).join(F.broadcast(top), F.col("share") == F.col("top_share"))
    limit = F.when(F.col("own_texts") >= LEAST_TEXTS, F.col("own")).when(F.col("up_texts") >= LEAST_TEXTS, F.col("up")).otherwise(F.col("top"))
    each = [F.max(F.when(F.col("share") == s, limit)).alias(f"most_{s}") for s in SHARES]
    return own.groupBy("lang", "source").agg(*each)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source; other columns aside): measures, limits, base_failed, kept.

    Words are runs without ASCII blanks. base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATS percent of them in
    8-word windows that the text has twice or more. kept: not base_failed and no share above the limit of the text's language and
    source; a group that the base rules fail as a whole has none. A null text counts as empty and fails. Null languages and sources are groups of their own. Rows with equal ids are
    judged one by one. An empty table gives an empty result.
    """
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]
    rows = kept(measured(docs.select(*wanted)))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    limits = thresholds(rows.filter(~base)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    rows = rows.join(limits, same, "left").drop("t_lang", "t_source")
    over = [cell(s) > F.col(f"most_{s}") for s in SHARES]
    fails = F.array_compact(F.array(*(F.when(o, F.lit(s)) for s, o in zip(SHARES, over))))
    rows = rows.withColumn("base_failed", base).withColumn("over", fails)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("over") == 0))
