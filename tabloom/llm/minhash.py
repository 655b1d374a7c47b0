"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity.

Shingles are runs of words. Two permutations make all coordinates of a
signature: the first scatters the shingles over 32-bit numbers, the second,
shifted on by one for each coordinate, is minimised over the scattered shingles.
Documents that agree on a band of ROWS coordinates are candidates; links are
confirmed on the full sets of shingles (as 64-bit hashes).

With b bands a pair of similarity s is missed with probability (1 - s**ROWS)**b;
b is chosen so that this is at most MISS at the threshold, and less above.

Large groups:
* Documents with equal sets are one class; only its smallest id goes on.
* In a bucket (documents with a band in common) every member is compared with one
  of them, not with all; see graph.bucket_components. For members that are still
  in several components then, the parities of 512 groups of shingles bound from
  below how far two sets are apart, which rules nearly all pairs out that are
  below the threshold; only the others' sets are compared.

Texts are read twice: for signatures, and for the sets of documents that have
candidates. Signatures, sets and links are kept in the shared folder.

Defined cases: NULL texts and texts without words have no shingles and no links;
texts with fewer words than a shingle are one shingle; ids are keys, and rows that
repeat one with its text get the same result; rows without id are linked by equal sets only, and have a NULL
component if no document with an id has their set; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.batches import free_name, text_batches
from tabloom.llm.graph import bucket_components
from tabloom.sources.files import materialise

ROWS = 4
MISS = 1e-6
WORDS = 5
THRESHOLD = (4, 5)
#: Ids that are broadcast at most (8 bytes each).
MOST_IDS = 1_000_000
#: Longs of parity bits.
PARITY = 8
_MEMO = 200_000
_BATCH = 1_000_000


class _WordHashes(dict):
    """64-bit hashes of words; those of the first _MEMO different words are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < _MEMO:
            self[word] = h
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(text: str | None, words: int, memo: dict) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. Letters A-Z count as a-z; words end at ASCII white space."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], np.uint64)
    each = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = len(found) - words + 1
    runs = np.zeros(n, np.uint64)
    for i in range(words):
        runs *= np.uint64(0x9E3779B97F4A7C15)
        runs += each[i : i + n]
    return np.unique(_mix64(runs))


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least of the second permutation, shifted by k, over the shingles placed by the first."""
    placed = (_mix64(shingles + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), 2048):
        x = placed[at : at + 2048][None, :] - shifts
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x7FEB352D)
        np.right_shift(x, np.uint32(15), out=t)
        x ^= t
        x *= np.uint32(0x846CA68B)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return key.view(np.int64)


def band_count(threshold: tuple[int, int], rows: int = ROWS, miss: float = MISS) -> int:
    s = threshold[0] / threshold[1]
    return 1 if s == 1 else math.ceil(math.log(miss) / math.log(1 - s**rows))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, np.int64)]).view(np.int64)))


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, fingerprint of the set, bands) for each row."""

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column("text"):
                s = shingle_hashes(text.as_py(), words, memo)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(signature(s, bands * ROWS)) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(keys)], ["doc_id", "n_shingles", "fingerprint", "bands"])

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY groups of shingles: is their number odd. Two sets differ in as many shingles at least as in bits."""
    odd = np.bincount((shingles >> np.uint64(20)) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles, parity) for each row."""

    def packed(ids, sets):
        bits = [parities(s.view(np.uint64)) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(sets), _lists(bits)], ["node", "shingles", "parity"])

    def run(batches):
        memo = _WordHashes()
        for batch in batches:
            ids, sets, size = [], [], 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(key)
                sets.append(shingle_hashes(text.as_py(), words, memo).view(np.int64))
                size += len(sets[-1])
                if size > _BATCH:
                    yield packed(ids, sets)
                    ids, sets, size = [], [], 0
            yield packed(ids, sets)

    return text_batches(docs).mapInArrow(run, "node long, shingles array<long>, parity array<long>")


def small(ids: DataFrame) -> DataFrame:
    """The ids with a broadcast hint if they are few enough."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def _linked(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    num, den = threshold
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b")).cast("long")
    joined = pairs.join(b, "v").join(a, "u").select("u", "v", common.alias("c"), (F.size("a") + F.size("b")).cast("long").alias("n"))
    return joined.where(F.col("c") * den >= (F.col("n") - F.col("c")) * num).select("u", "v")


def _links(classes: DataFrame, docs: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame | None:
    """(node, component) of classes (rep, n_shingles, bands) that are linked."""
    num, den = threshold
    each = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    full = each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(each.join(full, "key").withColumn("parity", F.lit(None).cast("array<long>")), "members")
    ids = materialise(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(ids), "doc_id", "left_semi")
    sets = materialise(shingle_sets(texts, words).dropDuplicates(["node"]), "sets")

    def near():
        both = F.col("n") + F.col("x_n")
        apart = sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("x_parity")[i])) for i in range(PARITY))
        alike = F.col("parity").isNull() | (apart * (den + num) <= both * (den - num))
        return (F.least("n", "x_n") * den >= F.greatest("n", "x_n") * num) & alike

    def enrich(open_: DataFrame) -> DataFrame:
        return open_.drop("parity").join(sets.select(F.col("node").alias("rep"), "parity"), "rep")

    return bucket_components(members, near, lambda pairs: _linked(pairs, sets, threshold), enrich)


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the smallest id that links lead to), kept (is it that one)."""
    found = materialise(signatures(docs, words, band_count(threshold)), "signatures")
    classes = found.where("n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = materialise(classes.where("rep is not null"), "classes")
    own = classes.select("fingerprint", "rep")
    parts = _links(classes, docs, words, threshold)
    if parts is not None:
        own = own.join(parts, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "rep").alias("rep"))
    rows = found.select("doc_id", "n_shingles", "fingerprint").join(own, "fingerprint", "left")
    # no class for texts without words, nor for ids that are NULL all over a class
    rows = rows.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest id, and one row of each id and text. Rows without id stay."""
    found = near_duplicates(docs, words, threshold)
    found = materialise(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")), "found")
    out = docs.join(small(found.where("not kept").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    many = found.where("kept and n > 1").select("doc_id")
    if many.head(1):
        many = small(many)
        print_ = free_name(out, "print")
        one = out.join(many, "doc_id", "left_semi").withColumn(print_, F.xxhash64("text")).dropDuplicates(["doc_id", print_]).drop(print_)
        out = out.join(many, "doc_id", "left_anti").union(one.select(docs.columns)).select(docs.columns)
    return out
