"""The language model's parts between shards and its files: what they hold, and how little room they take."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftspark.llm import kneser_ney
from shiftspark.llm.kneser_ney import language_model_scores


def test_parts_and_files_give_back_what_they_hold(tmp_path):
    rng = np.random.default_rng(3)
    for n, most in ((1, 1), (9, 5), (3000, 1 << 20), (3000, 1 << 40)):
        cols, counts = [rng.integers(0, most, n).astype(np.uint64) for _ in range(3)], rng.integers(1, most + 1, n)
        for k in (1, 2, 3):
            got = kneser_ney.unblob(kneser_ney.blob(cols[:k], [counts]))
            assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(*(x.tolist() for x in (*cols[:k], counts))))
        kneser_ney.save_rows(str(tmp_path), f"rows{n}-{most}", [counts, cols[0].astype(np.int64), counts])
        assert (kneser_ney.rows_at(f"{tmp_path}/rows{n}-{most}", np.arange(n)) == [counts, cols[0], counts]).all()
    for log in (0, 1, 7):
        for n in (1, 40, 50_000):
            keys = np.unique(rng.integers(0, 1 << 64 - log, n, np.uint64) | np.uint64(1 << 64 - log if log else 0))
            kneser_ney.save_keys(str(tmp_path), f"keys{log}-{n}", keys, log)
            asked = np.unique(np.concatenate([keys[::3], keys[1::3] ^ np.uint64(1)]))
            hit, at = kneser_ney.places_of(f"{tmp_path}/keys{log}-{n}", asked, log)
            assert (hit == np.flatnonzero(np.isin(asked, keys))).all() and (keys[at] == asked[hit]).all()


def test_language_model_takes_little_disk(spark, tmp_path, monkeypatch):
    """Files of the model of order 3: 14.4 bytes for each n-gram of any length before they were packed."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{w % 50_000}" for w in rng.zipf(1.3, 300)) for _ in range(700)]
    token = [t.split() + ["</>"] for t in texts]
    grams = sum(len({tuple((["<>"] * (k - 1) + t)[i : i + k]) for t in token for i in range(len(t))}) for k in (1, 2, 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(kneser_ney, "shared_folder", lambda _: str(tmp_path))
    assert language_model_scores(df, df, 3).agg(F.sum("n_tokens")).first()[0] == 700 * 301
    size = sum(f.stat().st_size for f in tmp_path.iterdir())
    assert size < 12 * grams


def test_training_texts_that_change_are_an_error(spark):
    new = F.udf(lambda: f"word {uuid.uuid4().hex}").asNondeterministic()
    df = spark.range(50).select(F.col("id").alias("doc_id"), new().alias("text"))
    with pytest.raises(Exception, match="differ when they are read again"):
        language_model_scores(df, df, 3).count()
