"""BPE encoding and decoding by a table of distinct words.

Tasks split texts into units that the tokenizer never merges across, and build for each block of texts a dictionary of its units. Spark
brings the rows of one unit together and encodes it once, sends the ids back to the units' places in their blocks, and joins ids to
pieces; each block's table becomes a file in the shared folder. A second pass splits the texts again, and each unit's place in its
block's dictionary gives its ids and its decoded form. What travels is one row for each block and unit, not one for each word.

A unit is a run without ASCII blanks, and of a run of plain Latin letters with closing marks the letters in lower case and the marks
by themselves, since this tokenizer drops blanks, lowers letters and never merges letters with marks.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import kept, ragged, raw, shared_folder, slices

#: Text bytes in a block: its dictionary and positions are one task's group.
BLOCK_BYTES = 32 << 20
#: Text bytes whose words are Python objects at once.
SPLIT_BYTES = 1 << 20
#: Units that the tokenizer gets at once.
ENCODED_UNITS = 1 << 13
#: Units of the texts that a task returns at once; a longer text goes alone.
SENT_UNITS = 1 << 18
#: Encoded units that a task bundles at once.
BUNDLED = 1 << 16
#: Vocabularies go to every worker; larger ones are refused.
MOST_PIECES = 1_000_000

RUN = re.compile(r"[^\x20\x09-\x0D]+")
#: Letters of two Latin blocks without the one whose lower case has two code points, then marks.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([.,;:!?]*)")


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encoded(path: str, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in one array, and how many each has."""
    ids = []
    for i in range(0, len(units), ENCODED_UNITS):
        ids += [e.ids for e in tokenizer(path).encode_batch_fast(units[i : i + ENCODED_UNITS], add_special_tokens=False)]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum())), lengths


class Units:
    """A growing dictionary of units; texts become positions in it."""

    def __init__(self) -> None:
        self.runs: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.first, self.second = array("q"), array("q")

    def add_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all texts' units in one array, and how many each text has."""
        runs, new = self.runs, self._new
        found = [RUN.findall(t) for t in texts]
        at = np.fromiter((runs[r] if r in runs else new(r) for f in found for r in f), np.int64, sum(map(len, found)))
        second = np.array(np.frombuffer(self.second, np.int64) if self.second else [], np.int64)
        two = second[at] >= 0 if len(at) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        lengths = np.bincount(doc, 1 + two, len(texts)).astype(np.int64)
        return self._joined(at, np.array(np.frombuffer(self.first, np.int64) if self.first else [], np.int64), second), lengths

    def _new(self, run: str) -> int:
        plain = PLAIN.fullmatch(run)
        parts = [plain[1].lower(), plain[2]] if plain else [run, ""]
        k = self.runs[run] = len(self.first)
        self.first.append(self.units.setdefault(parts[0], len(self.units)))
        self.second.append(self.units.setdefault(parts[1], len(self.units)) if parts[1] else -1)
        return k

    @staticmethod
    def _joined(at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.uint32)
        both = np.stack([first[at], second[at]], 1).ravel()
        return both[both >= 0].astype(np.uint32)


def packed(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list[str], list[np.ndarray]]]:
    """Texts in blocks: a name made from the texts, their ids, the dictionary of their units and each text's positions in it.

    Equal texts in equal order give equal blocks, names included, so what is stored for a block holds whenever the block is built again.
    """
    own, ids, at, size, name = Units(), [], [], 0, xxhash.xxh3_128()
    for b in slices(batches, limit=SPLIT_BYTES):
        flat, lengths = own.add_all(b.column("text").to_pylist())
        at += np.split(flat, np.cumsum(lengths)[:-1])
        ids += b.column("doc_id").to_pylist()
        data, off = raw(b.column("text"))
        name.update(np.ascontiguousarray(data))
        name.update(off.tobytes())
        size += len(data) + b.num_rows
        if size >= BLOCK_BYTES:
            done = [name.hexdigest(), ids, list(own.units), at]
            own, ids, at, size, name = Units(), [], [], 0, xxhash.xxh3_128()
            yield done.pop(0), done.pop(0), done.pop(0), done.pop(0)  # nothing of the block stays here
    if ids:
        done = [name.hexdigest(), ids, list(own.units), at]
        del own, ids, at, b, flat, data
        yield done.pop(0), done.pop(0), done.pop(0), done.pop(0)


def dictionaries(docs: DataFrame) -> DataFrame:
    """(block, units) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, units, _ in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([units], pa.list_(pa.string()))], ["block", "units"])

    return docs.mapInArrow(run, "block string, units array<string>")


def pieces(spark, path: str) -> DataFrame:
    """(id, piece) of the vocabulary, special tokens included; its size is checked."""
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    if len(vocab) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    return spark.createDataFrame(pd.DataFrame({"id": list(vocab.values()), "piece": list(vocab)}), "id int, piece string")


def bundles(held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(block, units): of each block the held units in one value: how many, then their places, numbers of ids and ids."""
    names = pa.chunked_array([h[1] for h in held]).dictionary_encode().combine_chunks()
    block = names.indices.to_numpy()
    k, lengths, ids = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
    order = np.argsort(block, kind="stable")
    starts = np.cumsum(lengths) - lengths
    cut = np.searchsorted(block[order], np.arange(len(names.dictionary) + 1))
    data = []
    for own in (order[a:b] for a, b in zip(cut[:-1], cut[1:])):
        data.append(packed(np.concatenate([[len(own)], k[own], lengths[own], ids[ragged(starts[own], lengths[own])]])))
    return pa.RecordBatch.from_arrays([names.dictionary, pa.array(data, pa.binary())], ["block", "units"])


def encoded_units(units: DataFrame, path: str) -> DataFrame:
    """units (unit, block, k) with the ids of the units, in bundles for each block: rows of one unit meet in one task, side by side, and
    it is encoded once there (once more where Arrow batches part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            words = b.column("unit").dictionary_encode()
            ids, lengths = encoded(path, words.dictionary.to_pylist())
            at = words.indices.to_numpy()
            starts = np.cumsum(lengths) - lengths
            held.append((b.column("k").to_numpy(), b.column("block"), lengths[at], ids[ragged(starts[at], lengths[at])]))
            rows += b.num_rows
            if rows >= BUNDLED:
                yield bundles(held)
                held, rows = [], 0
        if rows:
            yield bundles(held)

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "block string, units binary")


def unbundled(bundled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, numbers of ids and ids of all units in the bundles of a block, in order of their places and each once."""
    k, lengths, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    for data in bundled:
        numbers = unpacked(data)
        n = int(numbers[0])
        k.append(numbers[1 : n + 1])
        lengths.append(numbers[n + 1 : 2 * n + 1])
        ids.append(numbers[2 * n + 1 :])
    k, lengths, ids = np.concatenate(k), np.concatenate(lengths).astype(np.int64), np.concatenate(ids)
    starts = np.cumsum(lengths) - lengths
    k, order = np.unique(k, return_index=True)  # a block that occurs twice sends every unit twice
    return k, lengths[order], ids[ragged(starts[order], lengths[order])]


class Table:
    """Ids and decoded form of each unit of a block."""

    def __init__(self, folder: str, block: str):
        parts = np.load(f"{folder}/{block}.npz")
        self.ids, self.lengths = parts["ids"], parts["lengths"].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        pieces = parts["pieces"].tobytes().decode().split("\0")
        cuts = zip(self.starts.tolist(), (self.starts + self.lengths).tolist())
        names = [pieces[i] for i in self.ids.tolist()]
        self.decoded = np.array([" ".join(names[a:b]) for a, b in cuts], object)

    def text(self, at: np.ndarray) -> tuple[np.ndarray, str]:
        return self.ids[ragged(self.starts[at], self.lengths[at])], " ".join(w for w in self.decoded[at].tolist() if w)


def write_tables(folder: str):
    """Writes the table of one block: the ids of its units, and the pieces that the ids are joined to."""

    def run(key: tuple, units: pa.Table, vocabulary: pa.Table) -> pa.Table:
        block = (units if units.num_rows else vocabulary).column(0)[0].as_py()
        k, lengths, ids = unbundled(units.column("units").to_pylist())
        assert (k == np.arange(len(k))).all()
        names = [""] * (max(vocabulary.column("id").to_pylist(), default=-1) + 1)
        for i, piece in zip(vocabulary.column("id").to_pylist(), vocabulary.column("piece").to_pylist()):
            names[i] = piece
        small = np.uint16 if len(names) <= 1 << 16 else np.uint32
        short = np.min_scalar_type(int(lengths.max(initial=0)))
        part = f"{folder}/{block}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.savez_compressed(f, ids=ids.astype(small), lengths=lengths.astype(short), pieces=np.frombuffer("\0".join(names).encode(), np.uint8))
        os.replace(part, f"{folder}/{block}.npz")
        return pa.table([pa.array([block]), pa.array([len(k)], pa.int64())], ["block", "units"])

    return run


def encode_decode(docs: DataFrame, path: str, as_bytes: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs (doc_id, text): ids as the tokenizer file's encode without special tokens, decoded as
    its decode of them, special tokens kept. ids is an array, or `as_bytes` one binary value of little-endian unsigned 32-bit integers.

    docs is read twice and must come in the same order both times, as a stored table does; a block that differs is an error, not a
    wrong result. A null text counts as empty: no ids, empty decoded text. Repeated rows give a row each; other columns are left aside.
    An empty table gives an empty result. The tokenizer must drop blanks, lower-case, and decode with blanks between pieces
    (word_bpe_49k.json).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    known = kept(dictionaries(docs))
    vocabulary = pieces(spark, path)
    # the join of ids to pieces, for each block: every id of the vocabulary, whose size is checked
    ids = known.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0), F.lit(vocabulary.agg(F.max("id")).first()[0]))).alias("id"))
    ids = ids.join(F.broadcast(vocabulary), "id").select(F.col("block").alias("of"), "id", "piece")
    units = encoded_units(known.select("block", F.posexplode("units").alias("k", "unit")), path)
    written = units.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(write_tables(folder), "block string, units long")
    written.agg(F.sum("units")).first()
    names = ["doc_id", "ids", "decoded"]

    def sent(found: tuple[np.ndarray, ...]) -> pa.Array:
        if as_bytes:
            return pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())
        return pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, doc_ids, units, at in blocks(batches):
            del units
            table, a, b = Table(folder, block), 0, 0
            while a < len(at):
                size, b = 0, a
                while b < len(at) and (size == 0 or size + len(at[b]) < SENT_UNITS):
                    size, b = size + len(at[b]) + 1, b + 1
                found, text = zip(*map(table.text, at[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), sent(found), pa.array(text, pa.string())], names)
                a = b

    return docs.mapInArrow(join, f"doc_id long, ids {'binary' if as_bytes else 'array<int>'}, decoded string")
