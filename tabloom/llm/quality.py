"""A quality classifier: ordinal regression on graded ratings over hashed text.

A document's features are its words, in lower case, and its runs of signs, hashed
into BUCKETS, with the logarithm of their counts, plus counts of repeated, upper-case
and surplus words. All grades share one weight per bucket;
ordered thresholds cut the score into grades (a cumulative-link model with
logistic links):

    P(grade <= j) = 1 / (1 + exp(score - threshold[j]))

so a document gets its expected grade and the probability of the top grade, by
which documents are selected.

Grades from labels: 0 toxic, 1 of low quality, 2 neither.

The model is fitted on all labelled documents. Their features are kept in the shared
folder, as bytes that the JVM only hands on; each step of L-BFGS is a Spark job of PARTS tasks, each of which sums its rows'
gradient batch by batch, and of one more that adds these sums up, so the driver gets one
gradient a step, of the weights that are fitted only. One in five of the labelled isn't fitted on; the cut is the CLEAN_LOSS quantile of the top
grade's probability among those of top grade there. Texts are never shuffled: with more labels than
are broadcast, features are made of all documents and these meet the labels.

Defined cases: NULL text is empty; a text without words has score 0; labels of
missing documents are ignored, of repeated labels the lowest grade counts; NULL
labels and labels for NULL ids are ignored; with fewer than two grades labelled
nothing is judged (NULL grades) and all is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import compress
from operator import eq, itemgetter, ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.batches import free_name, text_batches
from tabloom.llm.minhash import small
from tabloom.sources.files import materialise, shuffles_deleted

BUCKETS = 1 << 17
CLEAN_LOSS = 0.005
LEAST_DOCS = 3
PENALTY = 1e-4
STEPS = 30
PARTS = 24
_OVER = 30
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text, by bucket; a bucket can come more than once."""
    tokens = _TOKEN.findall(text) if text else []
    counts = Counter(tokens)
    odd = {
        "\0repeated": sum(map(eq, tokens, tokens[1:])),
        "\0upper": sum(compress(counts.values(), map(str.isupper, counts))),
        "\0surplus": max(0, len(tokens) - 2 * len(counts)),
    }
    for word in list(compress(counts, map(ne, counts, map(str.lower, counts)))):
        counts[word.lower()] += counts.pop(word)
    counts.update({k: v for k, v in odd.items() if v})
    where = (np.fromiter(map(xxhash.xxh32_intdigest, counts), np.uint32, len(counts)) % BUCKETS).astype(np.int32)
    order = np.argsort(where, kind="stable")
    return where[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _values(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the model weighs, of documents that have so many of the counts each."""
    return np.log1p(counts.astype(float)) / np.repeat(np.sqrt(np.maximum(1, sizes)), sizes)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes).astype(int)


def _row_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.append(x, 0.0), starts) * (np.diff(np.append(starts, len(x))) > 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    """Weights by bucket, ordered thresholds, and the cut on the top grade's probability."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def scores(self, where: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _row_sums(self.weights[where] * _values(counts, sizes), _starts(sizes))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and threshold."""
        return _sigmoid(np.asarray(scores)[:, None] - self.thresholds)


def _thresholds(free: np.ndarray) -> np.ndarray:
    """The first threshold and the logarithms of the steps to the others, as thresholds."""
    return free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def loss_and_gradient(params: np.ndarray, n_grades: int, where, values, starts, grades) -> tuple[float, np.ndarray]:
    """The summed negative log-likelihood of rows in compressed form, and its gradient."""
    k = n_grades - 1
    weights, free = params[:-k], params[-k:]
    cuts = _thresholds(free)
    scores = _row_sums(weights[where] * values, starts)
    below = _sigmoid(np.concatenate(([-np.inf], cuts, [np.inf]))[None, :] - scores[:, None])
    below[:, 0], below[:, -1] = 0.0, 1.0
    rows = np.arange(len(grades))
    upper, lower = below[rows, grades + 1], below[rows, grades]
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    out = np.zeros_like(params)
    by_score = du - dl  # of the negative log-likelihood
    out[:-k] = np.bincount(where, np.repeat(by_score, np.diff(np.append(starts, len(where)))) * values, minlength=len(weights))
    by_cut = np.zeros(k + 2)
    np.add.at(by_cut, grades + 1, -du)
    np.add.at(by_cut, grades, dl)
    by_cut = by_cut[1:-1]
    out[-k] = by_cut.sum()
    if k > 1:
        out[-k + 1 :] = np.exp(free[1:]) * np.cumsum(by_cut[::-1])[::-1][1:]
    return float(-np.log(p).sum()), out


def lbfgs(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise f (value and gradient) by limited-memory BFGS with halving steps."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    value, gradient = f(x)
    for _ in range(steps):
        way, alphas = gradient.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ way) / (s @ y))
            way -= alphas[-1] * y
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.linalg.norm(gradient))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        step = 1.0
        while True:
            there = x - step * way
            after, slope = f(there)
            if after <= value - 1e-4 * step * (gradient @ way) or step < 1e-3:
                break
            step /= 2
        s, y = there - x, slope - gradient
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(value - after) < 1e-6 * max(1.0, abs(value))
        x, value, gradient = there, after, slope
        if done:
            break
    return x


def grade_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, quality, toxic)."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))


def described(docs: DataFrame) -> DataFrame:
    """The documents with ``where`` and ``counts``, their features as bytes, in place of the text.

    where has two bytes a bucket; the bit above them stands over the count, where it is a run of zeros and one of ones, as buckets are in order.
    """
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            own = [pa.array(x, pa.binary()) for x in ([w.astype(np.uint16).tobytes() for w, _ in found], [(n | w >> 16 << _OVER).tobytes() for w, n in found])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *own], [*rest, "where", "counts"])

    kept = text_batches(docs).select("text", *rest)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[1:], T.StructField("where", T.BinaryType()), T.StructField("counts", T.BinaryType())]))


def _labelled(found: DataFrame, graded: DataFrame) -> DataFrame:
    """(held, grade and the other columns) of the labelled rows of (doc_id, ...)."""
    chosen = graded.withColumnRenamed("doc_id", "_id")
    rest = [c for c in found.columns if c != "doc_id"]
    return found.join(chosen, F.col("doc_id") == F.col("_id")).select((F.xxhash64("doc_id", F.lit("held")) % 5 == 0).alias("held"), "grade", *rest)


def _featured(docs: DataFrame, graded: DataFrame) -> DataFrame:
    """(held, grade, where, counts) of the labelled documents."""
    docs = docs.select("doc_id", "text")
    few = small(graded)
    return _labelled(described(docs), graded) if few is graded else described(_labelled(docs, few))


def _compressed(batch: pa.RecordBatch) -> tuple:
    """(buckets, counts, the number of them in each row) of described rows."""

    where, counts = (batch.column(c).cast(pa.binary()) for c in ("where", "counts"))
    if not len(where):
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, int)
    sizes = pc.binary_length(where).to_numpy() // 2
    where, counts = (np.frombuffer(b"".join(x.to_pylist()), kind) for x, kind in ((where, np.uint16), (counts, np.int32)))
    return where.astype(np.int32) | counts >> _OVER << 16, counts & (1 << _OVER) - 1, sizes.astype(int)


def _added(parts: DataFrame) -> tuple[float, np.ndarray]:
    """The sums of loss and gradient of (part, loss, gradient), which a task adds up in the order of the parts, PARTS rows at most."""

    def run(batches):
        rows = sorted((x for b in batches for x in b.to_pylist()), key=itemgetter("part"))
        gradient = np.sum([np.frombuffer(x["gradient"]) for x in rows], axis=0)
        yield pa.RecordBatch.from_pydict({"loss": [sum(x["loss"] for x in rows)], "gradient": [gradient.tobytes()]})

    with shuffles_deleted(parts.sparkSession):
        got = parts.repartition(1).mapInArrow(run, "loss double, gradient binary").collect()[0]
    return got["loss"], np.frombuffer(got["gradient"])


def fit(docs: DataFrame, graded: DataFrame, n_grades: int = 3, clean_loss: float = CLEAN_LOSS) -> Model | None:
    """The model of all graded documents; None if fewer than two grades are there."""
    return _fitted(_featured(docs, graded), n_grades, clean_loss)


def _fitted(featured: DataFrame, n_grades: int = 3, clean_loss: float = CLEAN_LOSS) -> Model | None:
    sc = featured.sparkSession.sparkContext
    # the scan of the documents goes in all tasks; only what it wrote, of the labelled, is read in PARTS
    rows = materialise(featured, "features").coalesce(PARTS)
    train = rows.where("not held")

    def seen(batches):
        """The number of documents of each bucket, and, as if grades were more buckets, of each grade."""
        n = np.zeros(BUCKETS + n_grades, np.int64)
        for b in batches:
            where, _, sizes = _compressed(b)
            row = np.repeat(np.arange(len(sizes)), sizes)
            n[:BUCKETS] += np.bincount(np.unique(row * BUCKETS + where) % BUCKETS, minlength=BUCKETS)
            n[BUCKETS:] += np.bincount(b.column("grade").to_numpy(), minlength=n_grades)
        some = np.flatnonzero(n)
        for at in range(0, len(some), 10_000):
            yield pa.RecordBatch.from_pydict({"b": some[at : at + 10_000], "n": n[some[at : at + 10_000]]})

    counts = train.mapInArrow(seen, "b long, n long").groupBy("b").agg(F.sum("n").alias("n"))
    counts = {r["b"]: r["n"] for r in counts.where((F.col("n") >= LEAST_DOCS) | (F.col("b") >= BUCKETS)).collect()}
    grades = [n for b, n in counts.items() if b >= BUCKETS]
    total = sum(grades)
    if len(grades) < 2:
        return None
    known = np.zeros(BUCKETS + n_grades - 1, bool)
    known[[b for b in counts if b < BUCKETS]] = True
    known[BUCKETS:] = True
    fitted = np.flatnonzero(known)

    def objective(params: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast((params, fitted))

        def run(batches):
            loss, gradient = 0.0, None
            for b in batches:
                where, counts, sizes = _compressed(b)
                if len(sizes):
                    more, slope = loss_and_gradient(sent.value[0], n_grades, where, _values(counts, sizes), _starts(sizes), b.column("grade").to_numpy())
                    loss, gradient = loss + more, slope if gradient is None else gradient + slope
            if gradient is not None:
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "loss": [loss], "gradient": [gradient[sent.value[1]].tobytes()]})

        loss, slope = _added(train.mapInArrow(run, "part long, loss double, gradient binary"))
        sent.destroy()
        gradient = np.zeros_like(params)
        gradient[fitted] = slope / total
        gradient[:BUCKETS] += np.where(known[:BUCKETS], PENALTY * params[:BUCKETS], 0.0)
        return loss / total + PENALTY / 2 * float(params[:BUCKETS] @ params[:BUCKETS]), gradient

    start = np.zeros(BUCKETS + n_grades - 1)
    start[BUCKETS] = -2.0
    params = lbfgs(objective, start, STEPS)
    model = Model(params[:BUCKETS], _thresholds(params[BUCKETS:]))
    sent = sc.broadcast(model)

    def judge(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"top": sent.value.tails(sent.value.scores(*_compressed(b)))[:, -1]})

    best = rows.where(F.col("held") & (F.col("grade") == n_grades - 1)).mapInArrow(judge, "top double")
    cut = best.agg(F.percentile("top", F.lit(clean_loss)).alias("cut")).first()["cut"]
    return Model(model.weights, model.thresholds, min(0.9, cut) if cut is not None else 0.5)


_JUDGED = {"expected_grade": T.DoubleType(), "p_top": T.DoubleType(), "accepted": T.BooleanType()}


def judge(docs: DataFrame, model: Model | None, names: Sequence[str] = tuple(_JUDGED)) -> DataFrame:
    """The documents with expected_grade, p_top (the probability of the top grade) and accepted, or under other names."""

    def found(batch):
        each = [features(t.as_py()) for t in batch.column("text")]
        none = [np.empty(0, np.int32)]
        return np.concatenate([f[0] for f in each] + none), np.concatenate([f[1] for f in each] + none), np.array([len(f[0]) for f in each], int)

    return _judged(docs, model, names, found)


def _judged(docs: DataFrame, model: Model | None, names: Sequence[str], found: Callable) -> DataFrame:
    """The judgement by what ``found`` says of a batch's features, as _compressed does of described rows."""
    out = text_batches(docs.drop(*names))
    if model is None:
        return out.select("*", *(F.lit(None).cast("double").alias(n) for n in names[:2]), F.lit(True).alias(names[2]))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tails = sent.value.tails(sent.value.scores(*found(batch)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= sent.value.cut)], [*batch.schema.names, *names])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, *map(T.StructField, names, _JUDGED.values())]))


def quality_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The judgement of every document."""
    found, graded = materialise(described(docs.select("doc_id", "text")), "described"), grade_labels(labels)
    model = _fitted(_labelled(found, small(graded)))
    return _judged(found, model, tuple(_JUDGED), _compressed).select("doc_id", "expected_grade", "p_top", "accepted")


def select_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns of the input."""
    names = [free_name(docs, n) for n in _JUDGED]
    return judge(docs, fit(docs, grade_labels(labels)), names).where(F.col(names[2])).select(docs.columns)
