"""The corpus operators against brute force, on sample tables and on hostile rows."""

import collections
import gzip
import hashlib
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shiftspark.llm import catalog
from shiftspark.llm.bpe import encode_decode
from shiftspark.llm.classifier import quality_scores
from shiftspark.llm.common import Bits
from shiftspark.llm.jaccard import FRAGMENTS, bitmap, differing, jaccard_components, profiles, segments, signature, verified
from shiftspark.llm.kneser_ney import discounts, language_model_scores
from shiftspark.llm.language import language_id
from shiftspark.llm.packing import Windows, pack
from shiftspark.llm.quality_rules import quality_rules
from shiftspark.llm.shards import byte_shards
from shiftspark.llm.topk import top_k
from shiftspark.llm.warc import SOURCE, derivatives, digest, page, parsed, responses
from tests.conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
COLUMNS = "doc_id long, text string, lang string, source string, n long, cls long, block long, score double, share int, row long, unit int"


def odd_rows():
    """Nulls in every column, empty and very long texts, repeats, ties, odd characters."""
    rng = np.random.default_rng(1)
    pool = ["the", "house", "of", "İstanbul's", "Straße", "don't", "x2y", "<|endoftext|>", "naïve,", "καλός", "éa", "a b", "ΑΣ", "ﬁn", "🙂!", "\x1cq", "WORD"]
    long = " ".join(rng.choice(pool, 60_000))
    near = rng.permutation([f"w{i}" for i in range(60)]).tolist()
    texts = [None, "", " \n\t", "12 34 !!", "one", "One two three four", "one two three four", long, " ".join(near), " ".join(near[:-1] + ["end"]), " ".join(near), "q" * 5000 + " " + "z" * 300, "la casa de la ñ " * 30, "line a b\nline a b\n\nline a b"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "text without an id " * 9, None, None), (None, None, None, None), (10**15, " ".join(near), "en", "s")]
    return [(*r, 1, 2, None, 0.5, 3, 4, 5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def by_text(df, *cols):
    """Rows as a multiset."""
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_bpe_equals_the_library(odd, none, docs):
    t = Tokenizer.from_file(PATH)
    for df in (odd, docs):
        want = collections.Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
        got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encode_decode(df, PATH).collect())
        assert got == want
    assert encode_decode(none, PATH).count() == 0


def test_packing_holds_every_token_once(odd, none, docs):
    t = Tokenizer.from_file(PATH)
    for df in (odd, docs):
        rows = pack(df, PATH, 2048, with_ids=True).collect()
        room = collections.defaultdict(list)
        texts = collections.defaultdict(collections.Counter)
        for r in rows:
            room[r.sequence_id].append((r.offset, r.length))
            assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            texts[r.doc_id][r.start, tuple(r.ids)] += 1
        for places in room.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        want = collections.defaultdict(collections.Counter)
        for r in df.collect():
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
            for s in range(0, len(ids), 2048):
                want[r.doc_id][s, tuple(ids[s : s + 2048])] += 1
        assert texts == want
        assert 1 - sum(r.length for r in rows) / 2048 / len(room) < 0.05
    assert pack(none, PATH).count() == 0


def test_windows_are_bounded_and_best_fit():
    w = Windows(10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    assert len(w.left()) == 1
    w = Windows(10, 2)
    assert [w.place(n)[0] for n in (6, 7, 8, 4)] == [0, 1, 2, 0]
    assert len(w.left()) <= 2


def brute_components(rows):
    sets, par = [], list(range(len(rows)))
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                par[root(j)] = root(i)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return collections.Counter((d, len(sets[i]), (min(least[root(i)]) if least[root(i)] else None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_bitmaps_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), dtype=np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: int(rng.integers(0, len(x) + 1))]]))
        assert differing(bitmap(x), bitmap(y)) <= len(np.setxor1d(x, y))
        assert int(np.bitwise_count(signature(bitmap(x)) ^ signature(bitmap(y))).sum()) <= differing(bitmap(x), bitmap(y))
        assert differing(bitmap(x), bitmap(x)) == 0


def test_jaccard_join_equals_brute_force(spark, odd, none, docs):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    near = []
    for i in range(90):  # a large group of near copies, most of them not near to most others
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 5), replace=False):
            words[k] = f"{i}-{k}"
        near.append((1000 + i, " ".join(words)))
    shared = " ".join(f"p{i}" for i in range(55))
    near += [(2000 + i, shared + " " + " ".join(f"own{i}-{k}" for k in range(int(rng.integers(4, 60))))) for i in range(40)]
    more = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    both = odd.select("doc_id", "text").union(more).union(docs.select("doc_id", "text"))
    got = by_text(jaccard_components(both), "doc_id", "n_shingles", "component_id")
    assert got == brute_components([(r.doc_id, r.text) for r in both.collect()])
    assert jaccard_components(none).count() == 0


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(twice)


def test_quality_measures_equal_brute_force(odd, none, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (odd, docs):
        want = collections.Counter()
        for r in df.collect():
            m = brute_measures(r.text)
            want[(r.doc_id, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
        found = quality_rules(df)
        assert by_text(found, "doc_id", *names, "base_failed") == want
        assert found.filter("base_failed and kept").count() == 0
    assert quality_rules(none).count() == 0


def test_quality_rules_find_junk_and_keep_clean_texts(spark):
    sf = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    rows = catalog.QUERIES["op2_quality_rules"](spark, sf).filter("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r.n for r in rows.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def made(rng, i, symbols=0, upper=0, marks=0, same_lines=0):
    """25 lines of 10 words of 5 letters, of which so many in a hundred characters, words or lines are odd."""
    lines = [["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(10)] for _ in range(25)]
    words = [w for line in lines for w in line]
    for share, odd in ((symbols, lambda w: "#" + w[1:]), (upper, lambda w: w[0].upper() + w[1:])):
        for k in range(round(share * len(words) * 5 / 100)):
            words[k] = odd(words[k])
    for k in range(round(marks * len(words) / 100)):
        words[k] += "!"
    lines = [" ".join(words[10 * k : 10 * k + 10]) for k in range(25)]
    for k in range(round(same_lines * 25 / 100)):
        lines[2 * k] = "a b c d"
    return "\n".join(lines)


def test_quality_limits_follow_each_source(spark):
    rng = np.random.default_rng(2)
    for share, usual, asked in (("symbols", 12, 5), ("upper", 16, 12), ("marks", 40, 20), ("same_lines", 44, 28)):
        rows = [(i, made(rng, i, **{share: usual + int(rng.integers(-4, 5))}), "en", "odd") for i in range(60)]
        rows += [(100 + i, made(rng, i), "en", "plain") for i in range(60)]
        text = made(rng, 0, **{share: asked})
        rows += [(1000, text, "en", "odd"), (1001, text, "en", "plain")]
        found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert len(found) == len(rows) and all(found[i].kept for i in [*range(60), *range(100, 160)])
        assert found[1000].kept and not found[1001].base_failed and not found[1001].kept, share


def test_quality_rules_fail_words_that_repeat_the_word_before(spark):
    rng = np.random.default_rng(3)
    rows = [(i, made(rng, i), "en", "s") for i in range(60)]
    rows.append((100, " ".join(f"{w} {w} {w}" for w in made(rng, 0).split()), "en", "s"))
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert found[100].n_echoes == 500 and not found[100].base_failed and found[100].over == ["echoes"]
    assert all(found[i].kept for i in range(60))


def test_language_id(spark, odd, none):
    sf = SMALL.replace("0.001", "0.01")
    rows = catalog.QUERIES["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * n
    got = {(r.doc_id, r.lang_pred) for r in language_id(odd, odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (3, "und"), (None, "und")} <= got and len(got) >= 15
    assert language_id(none, none).count() == 0
    assert {(r.lang_pred, r.score) for r in language_id(odd, none).collect()} == {("und", 0.0)}


def test_language_profiles_rank_by_frequency_then_gram():
    from shiftspark.llm.language import Profiles, grams, ranked

    assert len(grams("ab")) == 2 + 3 + 2  # a b, " a" "ab" "b ", " ab" "ab "
    assert [int(g) for g in ranked("aab")][0] == ord("a")
    model = Profiles({"x": ranked("aaa bbb"), "y": ranked("ccc ddd")})
    assert model.predict("aaa bbb") == ("x", 1.0) and model.predict("ddd ccc")[0] == "y"


def test_classifier_on_held_out_labels(spark, odd, none):
    sf = SMALL.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = catalog.QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").filter("held_out")
    right, n = rows.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n
    marks = spark.createDataFrame([(4, 1), (4, 0), (8, 1), (None, 1), (12, None), (7, 0), (9, 2)], "doc_id long, label int")
    for df, m in ((odd, marks), (odd, marks.filter("false"))):
        scores = [r.score for r in quality_scores(df, m).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
    assert scores == [0.5] * len(scores)
    assert quality_scores(none, marks).count() == 0


def test_shards_are_even_gapless_and_keep_equal_texts_together(spark, odd, none, docs):
    copies = spark.range(400).select((F.col("id") + 50_000).alias("doc_id"), F.lit("copy " * 200).alias("text"))
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text").union(copies)):
        rows = byte_shards(df, 8).collect()
        assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        for shard in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
            assert 0 <= shard < 8
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values())
    assert byte_shards(none, 8).count() == 0


def test_top_k_equals_brute_force(spark, none):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 6)).round(1))]
    vectors += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (702, [math.nan] * 6), (703, [math.inf] * 6), (704, []), (705, [1.0, 2.0]), (None, [1.0] * 6), vectors[0], vectors[50]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x")).repartition(3)
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors[:700]}
    want = set()
    for q in range(0, 700, 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, 5).collect()]
    assert sorted(got) == sorted(want)
    assert top_k(df.filter("vec_id = 705"), F.col("vec_id") > 0, 5).count() == 0
    assert top_k(df.filter("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_a_row_repeated_many_times_is_spread_over_the_shards(spark):
    """A third of the rows, and more of the bytes, are one row."""
    one = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("again " * 80).alias("text"))
    rows = one.union(spark.range(100, 6100).select("id", F.concat(F.lit("text "), "id"))).repartition(4)
    found = byte_shards(rows, 8).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count_distinct("slot").alias("slots"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    sizes = [r["bytes"] for r in found]
    assert len(found) == 8 and max(sizes) < 1.05 * min(sizes)
    assert all(r["slots"] == r["n"] == r["last"] + 1 for r in found)


def test_top_k_of_large_components_is_exact(spark):
    """Products beyond 2^52 and 2^62, terms that cancel, and a component whose scores can't fit."""
    rows = [(0, [1.0, 0.0]), (1, [9e6, 0.0]), (2, [1.0, 1.0]), (3, [-9e6, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 1, 256 * 2304000000), (0, 2, 2, 256 * 256)]
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.integers(-4_000_000, 4_000_000, 4)]) for i in range(300)]
    vectors += [(300 + i, [4e6 + i, -4e6, 1.0 * i, 0.0]) for i in range(20)]
    whole = {i: [int(256 * x) for x in v] for i, v in vectors}
    want = set()
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in top_k(df, (F.col("vec_id") % 50 == 0) & (F.col("vec_id") < 200), 5).collect()} == want
    with pytest.raises(Exception, match="would not fit"):
        top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 1).collect()


def test_top_k_counts_an_id_with_several_vectors_once(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [8.0, 0.0]), (2, [7.0, 0.0]), (3, [6.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(few, F.col("vec_id") == 0, 2).collect()) == [(0, 1, 1, 9 * 256 * 256), (0, 2, 2, 7 * 256 * 256)]
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 60, 600), rng.integers(-9, 10, size=(600, 4)))]
    want = set()
    for q in range(0, 60, 20):
        best = {}
        for i, v in vectors:
            for own in (w for j, w in vectors if j == q and i != q):
                best[i] = max(best.get(i, -math.inf), sum(int(256 * a) * int(256 * b) for a, b in zip(own, v)))
        want |= {(q, rank + 1, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])}
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    assert {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, 5).collect()} == want


def brute_model(texts):
    """Modified Kneser-Ney over bigrams in plain dictionaries; returns a scoring function."""
    pairs = collections.Counter()
    for t in texts:
        toks = [*WORD.findall((t or "").translate(LOWER)), "</>"]
        pairs.update(zip(["<>", *toks], toks))
    count, before, after = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for (u, v), c in pairs.items():
        count[v] += c
        before[v] += 1
        after[u].append(c)
    d = discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    b = discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))
    mass = sum(b[min(n, 3)] for n in before.values()) / max(1, len(pairs))
    unknown = mass / (len(before) + 1) if pairs else 1.0
    lower = lambda v: unknown + (before[v] - b[min(before[v], 3)]) / len(pairs) if before[v] else unknown

    def p(u, v):
        if u not in after:
            return lower(v)
        c = pairs[u, v]
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in after[u]) * lower(v)) / sum(after[u])

    def score(t):
        toks = [*WORD.findall((t or "").translate(LOWER)), "</>"]
        n, types = sum(count.values()), len(count)
        base = sum(math.log10((count[x] + 1) / (n + types + 1)) for x in toks)
        return len(toks), sum(count[x] > 0 for x in toks), n, base, sum(math.log10(p(u, v)) for u, v in zip(["<>", *toks], toks))

    score.p, score.known = p, [*count, "never seen"]
    return score


def test_language_model_equals_brute_force(odd, none, docs):
    for df, train in ((odd, odd), (docs, docs.filter("doc_id % 3 > 0")), (odd, none)):
        model = brute_model([r.text for r in train.collect()])
        want = sorted((r.doc_id or -1, *model(r.text)) for r in df.collect())
        got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model_scores(df, train).collect())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-6, abs=1e-6)
    assert language_model_scores(none, odd).count() == 0
    model = brute_model(["a b a c a b", "b c", None])
    for u in ("a", "b", "<>", "zz"):
        assert sum(model.p(u, v) for v in model.known) == pytest.approx(1)


def brute_ngrams(texts, order):
    """Modified Kneser-Ney of any order in plain dictionaries, by its definition; returns p(context, token) and a scoring function."""
    toks = lambda t: ["<>", *WORD.findall((t or "").translate(LOWER)), "</>"]
    plain = [collections.Counter() for _ in range(order + 1)]
    for t in map(toks, texts):
        for i in range(1, len(t)):
            for k in range(1, min(order, i + 1) + 1):
                plain[k][tuple(t[i + 1 - k : i + 1])] += 1
    adjusted = [None] * order + [plain[order]]
    for k in range(order - 1, 0, -1):
        left = collections.Counter(g[1:] for g in plain[k + 1])
        adjusted[k] = {g: plain[k][g] if g[0] == "<>" else left[g] for g in plain[k]}
    cut, follow = [None], [None] + [collections.defaultdict(list) for _ in range(order)]
    for k in range(1, order + 1):
        cut.append(discounts(*(sum(c == j for c in adjusted[k].values()) for j in (1, 2, 3, 4))))
        for g, c in adjusted[k].items():
            follow[k][g[:-1]].append(c)

    def p(context, token):
        k = len(context) + 1
        below = p(context[1:], token) if context else 1 / (len(adjusted[1]) + 1)
        after = follow[k][context]
        if not after:
            return below
        c = adjusted[k].get((*context, token), 0)
        return (c - cut[k][min(c, 3)] + sum(cut[k][min(x, 3)] for x in after) * below) / sum(after)

    score = lambda t: sum(math.log10(p(tuple(toks(t)[max(0, i - order + 1) : i]), toks(t)[i])) for i in range(1, len(toks(t))))
    return p, score


def test_language_model_of_higher_order_equals_brute_force(spark, odd, docs, none):
    few = odd.filter("text is null or length(text) < 10000")
    for df, train, order in ((few, few, 3), (docs.limit(60), docs.limit(60).filter("doc_id % 3 > 0"), 3), (few, few, 4), (few, few, 2)):
        _, score = brute_ngrams([r.text for r in train.collect()], order)
        want = sorted((r.doc_id or -1, score(r.text)) for r in df.collect())
        rows = language_model_scores(df, train, order).collect()
        got = sorted((r.doc_id or -1, r.score) for r in rows)
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6, abs=1e-6)
        same = language_model_scores(df, train).collect()
        plain = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
        assert collections.Counter(tuple(r[c] for c in plain) for r in rows) == collections.Counter(tuple(r[c] for c in plain) for r in same)
    texts = ["a b a c a b", "b c", None, "c a b"]
    p, _ = brute_ngrams(texts, 3)
    for context in (("a", "b"), ("<>", "a"), ("<>",), ("zz", "a"), ("zz", "zz")):
        assert sum(p(context, t) for t in ("a", "b", "c", "</>", "never seen")) == pytest.approx(1)
    assert {r.score for r in language_model_scores(odd, none, 3).collect()} == {0.0}
    assert language_model_scores(none, odd, 3).count() == 0


def test_query_scores_by_more_than_the_word_before(spark, tmp_path):
    texts = ["red eats hens", "blue eats figs"] * 60 + ["red eats figs", "blue eats hens"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    score = {texts[r.doc_id]: r.score for r in catalog.QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert score["red eats hens"] > score["red eats figs"] + 0.5 and score["blue eats figs"] > score["blue eats hens"] + 0.5


def test_pipeline_stages(spark, odd, docs, none):
    rows = odd.union(docs.select(F.col("doc_id") + 10**6, "text", "lang", "source", *(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes[4:])))
    stages = dict(corpus_pipeline.STAGES)
    quality = stages["quality rules"](spark, rows, "")
    assert quality.columns == rows.columns
    kept = {r.doc_id for r in quality_rules(rows).filter("kept").collect()}
    assert {r.doc_id for r in quality.collect()} == kept
    lang = stages["language ID"](spark, rows, "")
    assert lang.columns == rows.columns and {0, 1, 2, 3}.isdisjoint(r.doc_id for r in lang.collect())
    assert by_text(rows.select("doc_id", "row"), "doc_id", "row") >= by_text(lang.select("doc_id", "row"), "doc_id", "row")
    near = stages["near duplicates"](spark, rows, "")
    assert near.columns == rows.columns
    groups = brute_components([(r.doc_id, r.text) for r in rows.collect()])
    left = collections.Counter(r.doc_id for r in near.collect())
    for (doc_id, n, component), times in groups.items():
        if n == 0:
            assert left[doc_id] >= 1
        elif doc_id is not None and component is not None and doc_id != component:
            assert doc_id not in left
        elif doc_id is not None:
            assert left[doc_id] == 1
    assert stages["packing"](spark, near, "").select("doc_id").distinct().count() >= 1
    assert all(f(spark, none, "").count() == 0 for _, f in corpus_pipeline.STAGES)


def test_pipeline_stages_keep_columns_of_any_type_and_prefer_named_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, "en", "s", {"k": "v"}, 1), (5, text, "en", "s", {"k": "w"}, 2), (3, text + " end", "en", "s", None, 3), (None, "other " * 3 + "words of one", "en", "s", {}, 4), (None, None, None, None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, more map<string,string>, __row int")
    near = corpus_pipeline.near_duplicates(spark, df, "")
    assert near.columns == df.columns and sorted(r["__row"] for r in near.collect()) == [3, 4, 5]
    for stage in (corpus_pipeline.quality, corpus_pipeline.language):
        kept_rows = stage(spark, df, "")
        assert kept_rows.columns == df.columns and {r["__row"] for r in kept_rows.collect()} <= {1, 2, 3, 4}
    assert {r.more["k"] for r in corpus_pipeline.language(spark, df.filter("__row < 3"), "").collect()} == {"v", "w"}


def test_query_digests(spark):
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = set()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in catalog.QUERIES["op4_bpe_words"](spark, SMALL).collect()} == want


def test_all_ten_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_warc_page_text_and_links():
    text = '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>one<br>two <b>bold</b></p><a href="/x?a=1&amp;b=2">go</a><img src=i.png><p>un < closed <a <a href=http://[bad>z</a>'
    title, plain, links = page(text, "http://h.example/d/p.html")
    assert title == "A & B" and "var" not in plain and "one\ntwo bold" in plain and "un < closed" in plain
    assert [x["url"] for x in links[:2]] == ["http://h.example/x?a=1&b=2", "http://h.example/d/i.png"]


def test_warc_records_round_trip(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("url", "html")
    hostile = [(None, None), ("", ""), ("http://a.example/", "<p>" * 5000 + "x" * 100_000), ("http://a.example/", "plain"), ("http://a.example/", "plain"), ("http://b.example/\r\nX: y", "<script>never closed")]
    df = pages.union(spark.createDataFrame(hostile, "url string, html string")).withColumn("date", F.lit("clash"))
    source = {r.record_id: r for r in responses(df).collect()}
    rows = derivatives(responses(df)).collect()
    assert len(rows) == 2 * df.count() and all(r.digests_match and r.http_status == 200 for r in rows)
    assert collections.Counter(r.warc_type for r in rows) == {"metadata": df.count(), "conversion": df.count()}
    for r in rows:
        headers, content = parsed(bytes(r.record))
        own = source[r.refers_to]
        assert headers["WARC-Refers-To"] == own.record_id and headers["WARC-Record-ID"] == r.record_id and content.decode() == r.content
        assert headers["WARC-Block-Digest"] == digest(content) and r.source_payload_digest == own.payload_digest
        assert headers.get("WARC-Target-URI") == (own.target_uri and " ".join(own.target_uri.split()))
    assert len({r.record_id for r in rows}) == 2 * len(source)
    bare = spark.createDataFrame([(None,) * 7, ("<urn:x>", "u", "d", "sha256:0", None, bytearray(b"no head"), None)], SOURCE)
    got = {(r.warc_type, r.refers_to is None, r.digests_match, r.http_status) for r in derivatives(bare).collect()}
    assert got == {(k, False, m, None) for k in ("metadata", "conversion") for m in (True, False)}
    assert derivatives(bare.filter("false")).count() == 0


def response(headers, payload):
    return bytearray("".join(["HTTP/1.1 200 OK\r\n", *(f"{k}: {v}\r\n" for k, v in headers), "\r\n"]).encode("latin-1") + payload)


def test_warc_bodies_are_read_as_their_headers_say(spark):
    page_ = "<p>für Öl</p>"
    many = [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("X", "y:z")]
    cases = {
        "latin": ([("Content-Type", "text/html; charset=ISO-8859-1"), *many], page_.encode("latin-1"), "für Öl"),
        "declared": ([("Content-Type", "text/html")], f"<meta charset=windows-1252>{page_}".encode("cp1252"), "für Öl"),
        "unknown charset": ([("content-type", "text/html; charset=none-such")], page_.encode(), "für Öl"),
        "gzip": ([("Content-Encoding", "gzip")], gzip.compress(page_.encode()), "für Öl"),
        "chunked": ([("Transfer-Encoding", "chunked"), ("Content-Encoding", "deflate")], (lambda z: b"%x\r\n%b\r\n%x;q=1\r\n%b\r\n0\r\n\r\n" % (4, z[:4], len(z) - 4, z[4:]))(zlib.compress(page_.encode())), "für Öl"),
        "plain": ([("Content-Type", "text/plain")], b"a < b <p>", "a < b <p>"),
        "image": ([("Content-Type", "image/png")], b"\x89PNG", None),
        "unknown encoding": ([("Content-Encoding", "br")], b"\x1b\x00", None),
        "not gzip": ([("Content-Encoding", "gzip")], b"<p>text", None),
    }
    rows = [(name, f"http://h.example/{name}", "2024-05-06T07:08:09Z", None, None, response(h, data), [("WARC-Type", "response"), ("WARC-IP-Address", "192.0.2.1")]) for name, (h, data, _) in cases.items()]
    found = {(r.refers_to, r.warc_type): r for r in derivatives(spark.createDataFrame(rows, SOURCE)).collect()}
    for name, (h, _, want) in cases.items():
        text, meta = found[name, "conversion"], json.loads(found[name, "metadata"].content)
        assert (text.content, text.converted) == (want or "", want is not None), name
        assert meta["headers"] == [list(x) for x in h] and meta["warc-headers"] == [["WARC-Type", "response"], ["WARC-IP-Address", "192.0.2.1"]]
        head, _ = parsed(bytes(text.record))
        assert (head["WARC-Refers-To"], head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"]) == (name, f"http://h.example/{name}", "2024-05-06T07:08:09Z")
    without = spark.createDataFrame(rows, SOURCE).drop("headers")
    assert derivatives(without).filter("converted").count() == 2 * sum(w is not None for _, _, w in cases.values())


def test_equal_pages_of_different_ids_are_different_records(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (None, "u", "x")], "page_id long, url string, html string")
    assert responses(pages).select("record_id").distinct().count() == 3
    assert responses(pages.drop("page_id")).select("record_id").distinct().count() == 1


def test_overlaps_are_counted_by_fragment_and_summed_by_pair(spark, docs):
    """Rows of the plan: (pair, fragment) from two joins on class and fragment, then a sum by pair."""
    rows = docs.select("doc_id", "text")
    own = profiles(rows, 5).filter("n > 0 and gram is null").select("cls", "n", "bits").dropDuplicates(["cls"])
    some = own.select("cls").orderBy("cls").limit(60)
    pairs = some.withColumnRenamed("cls", "a").crossJoin(some.withColumnRenamed("cls", "b")).filter("a < b")
    found = verified(pairs, rows, own, 5, 80)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "sum(overlap" in plan and plan.count("Join Inner") >= 2 and f"explode(sequence(0, {FRAGMENTS - 1}" in plan
    sets = {}
    for r in segments(rows, 5, Bits(some, "cls")).collect():
        sets.setdefault(r.cls, set()).update(r.grams)
        assert {g % (1 << 64) >> 64 - (FRAGMENTS - 1).bit_length() for g in r.grams} == {r.fragment} and len(r.grams) <= r.n
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    chosen = {r.cls for r in some.collect()}
    assert {(r.a, r.b) for r in found.collect()} == {p for p in want if set(p) <= chosen}
