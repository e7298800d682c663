"""Toxicity by class-conditional Kneser-Ney models.

Two models over the signs of each word, one learned from toxic and one from ordinary texts. A sign is told by what
stands before it in its word, up to ORDER - 1 signs: a class's discounted counts there back off to counts of both
classes pooled at the next lower order, which are Kneser-Ney continuation counts down to single signs. So an expression
that is rare, or that one class alone has, costs both classes about the same, and only contexts that both classes know
part them. Signs rather than words catch insults with endings never met before; every code point is a sign of its own.

A toxic text is mostly ordinary, so its words come from the toxic model with a small share, from the ordinary one
otherwise. The difference of the two log-likelihoods is divided by the number of words; a logistic, fitted on rows kept
from counting, makes it a score.

What is learned is bounded by `ROWS` labelled rows and `SAMPLE_BYTES` of text of each class, and by nothing else: all
n-grams of these rows count. The model is so small enough to be sent to every executor. Scoring reads each text once
and moves nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import crc_mod, give_back, materialise, slices
from gramwise.llm.tokens import BASES, Rolling, mix, words

U = np.uint64
#: Labelled rows of each class to learn from, in the order of a hash of their ids, and the bytes of their texts.
ROWS, SAMPLE_BYTES = 8_000, 6 << 20
#: Signs of an n-gram.
ORDER = 10
#: Shares of toxic words in a toxic text; the one that tells the calibration rows apart best is taken.
SHARES = (0.1, 0.03, 0.01)
#: Stand before and after each word; no code points.
BEGIN, END = 0x110000, 0x110001
MARKS = ".,;:!?\"'()[]|"
FOLDS, CALIBRATION = 5, 4


class Spelled:
    """The signs of words between BEGIN and END, one word after another, and hashes of their runs."""

    def __init__(self, flat: pa.Array):
        flat = pc.utf8_trim(flat, characters=MARKS)
        points = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32)
        n = pc.utf8_length(flat).to_numpy().astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(n + 2)))
        self.signs = np.full(self.starts[-1], END, np.uint32)
        if len(n):
            self.signs[self.starts[:-1]] = BEGIN
            self.signs[np.repeat(self.starts[:-1] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())] = points
        self.roll = Rolling(mix(self.signs.astype(U) + U(1)), BASES[0])
        #: The signs to be told, and how many of their word stand before each, BEGIN among them.
        before = np.arange(len(self.signs)) - np.repeat(self.starts[:-1], n + 2)
        self.at = np.flatnonzero(before)
        self.before = before[self.at]

    def word(self) -> np.ndarray:
        """The word of each sign to be told."""
        return np.searchsorted(self.starts, self.at, side="right") - 1

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest context of each sign, and the context with the sign, as hashes."""
        size = np.minimum(self.before, ORDER - 1)
        return self.roll.at(self.at - size, size), self.roll.at(self.at - size, size + 1)


def _found(sorted_keys: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys there are, and their values."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[i] == keys, values[i]


@dataclass
class Model:
    grams: np.ndarray  # hashes of contexts with a sign, sorted
    gain: np.ndarray  # log of P(toxic) / P(ordinary) of that sign after its context
    contexts: np.ndarray  # hashes of contexts, sorted
    back: np.ndarray  # log of the ratio of what the classes leave there for signs they don't know
    share: float = SHARES[0]
    slope: float = 1.0
    shift: float = 0.0
    known: bool = True  # learned from rows of both classes

    def words(self, flat: pa.Array) -> np.ndarray:
        """The log-likelihood ratio of each word, under the two models alone."""
        if not len(flat):
            return np.zeros(0)
        s = Spelled(flat)
        context, gram = s.grams()
        own, back = np.unique(gram, return_inverse=True)
        hit, value = _found(self.grams, own, self.gain)
        hit, value = hit[back], value[back]
        miss = np.flatnonzero(~hit)
        there, lost = _found(self.contexts, context[miss], self.back)
        value[miss] = np.where(there, lost, 0.0)
        # Each word has its END to be told, so none is empty.
        return np.add.reduceat(value, s.starts[:-1] - np.arange(len(flat)))

    def ratio(self, texts: pa.Array, shares: tuple[float, ...] = ()) -> np.ndarray:
        """The log-likelihood ratio of each text, per word, for each share of toxic words; 0 for texts without words."""
        w = words(texts, lower=True)
        n = np.diff(w.starts)
        coded = w.flat.dictionary_encode()
        own, which, out = np.minimum(self.words(coded.dictionary), 500.0), coded.indices.to_numpy(), []
        for share in shares or (self.share,):
            mixed = np.log1p(share * np.expm1(own))
            sums = np.concatenate(([0.0], np.cumsum(mixed[which]) if len(which) else []))
            out.append((sums[w.starts[1:]] - sums[w.starts[:-1]]) / np.maximum(n, 1))
        return np.stack(out) if shares else out[0]

    def exponent(self, texts: pa.Array) -> np.ndarray:
        return self.slope * self.ratio(texts) + self.shift


def discount(counts: np.ndarray) -> float:
    """What Kneser-Ney takes from each count, from how many there are of one and of two; within what is sensible."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def _shared(s: Spelled, weight: np.ndarray) -> np.ndarray:
    """The pooled probability of each sign to be told after what stands before it, less the first sign of its longest
    context. weight: how often each word comes."""
    word = s.word().astype(np.int32)

    def level(k: int):
        at = np.flatnonzero(s.before + 1 >= k).astype(np.int32)
        keys, first, back = np.unique(s.roll.at(s.at[at] - k + 1, k), return_index=True, return_inverse=True)
        return at, first.astype(np.int32), back.astype(np.int32), len(keys)

    at, first, back, n = level(1)
    below = np.full(len(s.at), 1.0 / max(n, 1))
    low = below.copy()
    for k in range(1, ORDER):
        count = np.bincount(back, weight[word[at]], n)
        above = level(k + 1) if k < ORDER - 1 else None
        if above is not None:  # how many different signs stand before, but for what begins a word
            place = np.zeros(len(s.at), np.int32)
            place[at] = back
            kinds = np.bincount(place[above[0][above[1]]], minlength=n)
            count = np.where(s.before[at[first]] + 1 > k, kinds, count)
        contexts, group = np.unique(s.roll.at(s.at[at[first]] - k + 1, k - 1), return_inverse=True) if k > 1 else (np.zeros(1, U), np.zeros(n, np.int64))
        total, types, d = np.bincount(group, count, len(contexts)), np.bincount(group, count > 0, len(contexts)), discount(count)
        under = below[at[first]]
        p = np.where(total[group] > 0, (np.maximum(count - d, 0) + d * types[group] * under) / np.maximum(total[group], 1e-9), under)
        below[at] = p[back]
        has = s.before >= k
        low[has] = below[has]
        if above is not None:
            at, first, back, n = above
    return low


def build(flat: pa.Array, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The two models from distinct words and in how many toxic and ordinary texts each is."""
    s = Spelled(flat)
    low, word = _shared(s, (toxic + ordinary).astype(float)), s.word().astype(np.int32)
    context, gram = s.grams()
    grams, first, back = np.unique(gram, return_index=True, return_inverse=True)
    contexts, group = np.unique(context[first], return_inverse=True)
    low, p, left = low[first], [], []
    for c in (toxic.astype(float), ordinary.astype(float)):
        n = np.bincount(back, c[word], len(grams))
        d, total, types = discount(n), np.bincount(group, n, len(contexts)), np.bincount(group, n > 0, len(contexts))
        rest = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        left.append(rest)
        p.append(np.where(total[group] > 0, np.maximum(n - d, 0) / np.maximum(total[group], 1), 0.0) + rest[group] * low)
    return Model(grams, np.log(p[0] / p[1]), contexts, np.log(left[0] / left[1]))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(loss, slope, shift) of a logistic by Newton's method on standardised values; slope 1 for values of one class."""
    if not len(x) or y.min() == y.max():
        return 0.0, 1.0, 0.0
    mid, scale = x.mean(), max(x.std(), 1e-9)
    z = np.stack(((x - mid) / scale, np.ones(len(x))), 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 1e-3 * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -5, 5)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    margin = np.clip(z @ w, -30, 30)
    loss = float(np.mean(np.log1p(np.exp(margin)) - y * margin))
    return loss, w[0] / scale, w[1] - w[0] * mid / scale


def _col(name: str):
    return F.col(f"`{name}`")


def fitting(names: list[str], sizes: list[int], room: int) -> list[str]:
    """The first names whose sizes fit the room together; one that doesn't fit what is left is passed over. If none fits, the
    smallest is taken."""
    out = []
    for name, size in zip(names, sizes, strict=True):
        if size <= room:
            out.append(name)
            room -= size
    return out or names[:1] and [min(zip(sizes, names, strict=True))[1]]


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _toxic, _fold) of the ids to learn from. An id with several labels is toxic if one of them says so."""
    marked = labels.where(_col(id_col).isNotNull() & _col(label_col).isNotNull()).groupBy(_col(id_col).alias("_id")).agg(F.max(_col(label_col).cast("int")).alias("_toxic"))
    return marked.withColumn("_fold", crc_mod(F.col("_id"), FOLDS)).where("_fold != 0 and _toxic in (0, 1)")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from rows of docs that labels marks and whose crc32(id) mod 5 is not 0.

    Of these, remainders 1 to 3 are counted and remainder 4 sets the share of toxic words and the logistic. Of each class
    ROWS are taken, in the order of a hash of their ids, and of their texts those that fit SAMPLE_BYTES together: one that
    is too long is passed over, and if all are, the shortest is taken. Texts are taken whole. Of equal texts one counts, the
    toxic one with the smallest id, of rows that repeat an id one, and a word once in each text. Null ids and labels are
    left out.
    """
    marked = labelled(labels, id_col, label_col)
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = marked.where("_toxic = 1").orderBy(*order).limit(ROWS).unionByName(marked.where("_toxic = 0").orderBy(*order).limit(ROWS))
    chosen = materialise(chosen, "labelled")
    # At most 2 * ROWS rows of three numbers: this may always be sent.
    found = docs.select(_col(id_col).alias("_id"), F.coalesce(_col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    # One text of an id; of equal texts the toxic one with the smallest id. So there are no more rows than ids.
    of_id = found.groupBy("_id", "_toxic", "_fold").agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")).alias("x")).select("_id", "_toxic", "_fold", "x.*")
    sample = of_id.groupBy("digest", "text").agg(F.min(F.struct((-F.col("_toxic")).alias("clean"), "_id", "_fold")).alias("x"))
    sample = materialise(sample.select((-F.col("x.clean")).alias("_toxic"), "x._fold", F.xxhash64("x._id").alias("_hash"), "digest", F.octet_length("text").alias("_size"), "text"), "sample")
    sizes = sample.select("_toxic", "_hash", "digest", "_size").toPandas().sort_values(["_hash", "digest"])  # a few numbers of each of at most 2 * ROWS rows
    kept = [x for _, own in sizes.groupby("_toxic") for x in fitting(own["digest"].tolist(), own["_size"].tolist(), SAMPLE_BYTES)]
    # As many digests at most.
    sample = sample.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in kept], "digest string")), "digest", "left_semi")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column(1), lower=True)
                coded = w.flat.dictionary_encode()
                size = max(len(coded.dictionary), 1)
                once = np.unique(w.rows * size + coded.indices.to_numpy())
                toxic, which = part.column(0).to_numpy(zero_copy_only=False).astype(bool)[once // size], once % size
                n = [np.bincount(which[x], minlength=len(coded.dictionary)).astype(np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *map(pa.array, n)], ["word", "toxic", "ordinary"])

    counted = sample.where(F.col("_fold") != CALIBRATION).select("_toxic", "text").mapInArrow(count, "word string, toxic long, ordinary long")
    # The distinct words of 2 * SAMPLE_BYTES of text at most.
    table = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).orderBy("word").toArrow()
    toxic, ordinary = (table.column(c).to_numpy() for c in ("toxic", "ordinary"))
    if not toxic.any() or not ordinary.any():
        none = np.zeros(0)
        return Model(none.astype(U), none, none.astype(U), none, slope=0.0, known=False)
    model = build(table.column("word").combine_chunks(), toxic, ordinary)
    held = ratios(sample.where(F.col("_fold") == CALIBRATION).select("_toxic", "text"), model, "_toxic", shares=SHARES).toPandas()  # a few numbers of each of at most 2 * ROWS rows
    y = held["_toxic"].to_numpy(float)
    fits = [(*fit_logistic(held[f"ratio{k}"].to_numpy(float), y), share) for k, share in enumerate(SHARES)]
    _, model.slope, model.shift, model.share = min(fits)
    # The sample may take the classes unlike; the shift is set back to how common they are among all labelled rows.
    share = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    took = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    model.shift += float(np.log(share[1] / share[0]) - np.log(took[1] / took[0]))
    return model


def ratios(docs: DataFrame, model: Model, id_col: str, text_col: str = "text", shares: tuple[float, ...] = ()) -> DataFrame:
    """(id, ratio): the difference of the log-likelihoods per word; ratio0, ratio1.. for several shares."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[id_col].dataType.simpleString()
    names = [f"ratio{k}" for k in range(len(shares))] or ["ratio"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.atleast_2d(sent.value.ratio(part.column(1), shares))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], ["_id", *names])

    found = docs.select(_col(id_col).alias("_id"), _col(text_col).alias("text")).mapInArrow(run, f"_id {kind}, {', '.join(f'{n} double' for n in names)}")
    return found.withColumnRenamed("_id", id_col)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    held_out says that crc32(id as text) mod 5 is 0: such rows are never learned from. A null or empty text has a
    ratio of 0 and the score that goes with it. Where the labels give no rows of both classes to count, every score is
    0.5. Rows that repeat an id are scored each, null ids too.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    exponent = F.lit(model.slope) * F.col("ratio") + F.lit(model.shift)
    scored = ratios(docs, model, id_col, text_col).withColumn("score", 1 / (1 + F.exp(-exponent)))
    return scored.select(_col(id_col), (crc_mod(_col(id_col), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject (score below 0.5), with all columns, in one pass: no join by id.

    Where there is nothing to learn from, all rows stay.
    """
    model = train(docs, labels, id_col, text_col)
    if not model.known:
        return docs
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(sent.value.exponent(part.column(at)) < 0))
                give_back()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
