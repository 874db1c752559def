"""Problem 8: reading level of each document.

Every sentence gets a distribution over the levels from a regularised multinomial model of its words and
characters (hashed word and character n-grams and length classes); a document's level comes from the
distributions of its sentences, weighted by their length, through a calibration on graded documents.
Models are trained on a bounded sample of graded documents, each fit a task of its own on the executors,
and applied to whole texts in one scan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written

#: Graded documents the models are fitted on, at most: those whose hashed id is smallest, whole, until they hold so many characters.
TRAINING_DOCUMENTS = 1_500
TRAINING_CHARACTERS = 8_000_000
#: Parts of the sample that are graded in turn by a model fitted on the others, for the calibration.
FOLDS = 2
PROSE_KINDS = ("notice", "letter", "memo", "help_article")
LEVELS = 5
#: Documents of this level and above are demanding.
DEMANDING = 4

BITS = 18
PASS_CHARS = 1 << 19
SLICE_FEATURES = 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower-case form with digits and spaces unified, whether it is part of a word, whether it is a word by itself."""
    n = 0x30000
    lower, word, single = np.arange(n, dtype=np.uint32), np.zeros(n, np.bool_), np.zeros(n, np.bool_)
    for o in range(n):
        if 0xD800 <= o < 0xE000:
            continue
        c = chr(o)
        low = c.lower()
        if len(low) == 1 and ord(low) < n:
            lower[o] = ord(low)
        if c.isdecimal():
            lower[o] = 0x30
        if c.isspace():
            lower[o] = 0x20
        word[o] = c.isalnum() or c == "'"
        single[o] = 0x3400 <= o < 0xA000 or 0x20000 <= o
    word[single] = False
    return lower, word, single


def _mix(h: np.ndarray) -> np.ndarray:
    """Bucket of a 64-bit rolling value."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Sentences:
    """Hashed features of the sentences of some texts: bucket f belongs to sentence owner[f]; owner ascends within each family."""

    buckets: list[np.ndarray]
    owners: list[np.ndarray]
    text: np.ndarray  # text of each sentence
    size: np.ndarray  # characters of each sentence


def sentences(texts: list[str]) -> Sentences:
    """Split texts into sentences and hash their features; all on arrays."""
    lower, word, single = _tables()
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(lower), codes, 0xFFFD)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(codes)
    if not n:
        return Sentences([], [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    low = lower[codes]
    first = np.zeros(n + 1, np.bool_)
    ends = np.cumsum(sizes)
    first[ends - sizes] = True
    first = first[:n]

    # A sentence ends after CJK stops, line ends, and after . ! ? ; where white space and then no small letter follows.
    space = low == 0x20
    after = np.append(codes[1:], 0x20)
    after2 = np.append(codes[2:], [0x41, 0x41])[:n]
    small = (lower[after2] == after2) & word[after2]
    stop = np.isin(codes, [0x3002, 0xFF01, 0xFF1F, 0x0A, 0x0D]) | (np.isin(codes, [0x2E, 0x21, 0x3F]) & (lower[after] == 0x20) & ~small)
    start = first.copy()
    start[1:] |= stop[:-1]
    sentence = np.cumsum(start) - 1
    count = int(sentence[-1]) + 1
    begin = np.flatnonzero(start)
    text = np.searchsorted(ends, begin, "right")
    ink = np.add.reduceat((~space).astype(np.int64), begin)

    buckets, owners = [], []
    value = low.astype(np.uint64) * _SEED
    # Character trigrams and four-grams inside a sentence.
    for k in (3, 4):
        if n >= k:
            h = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                h = h * np.uint64(0x100000001B3) + value[i : n - k + 1 + i]
            same = sentence[: n - k + 1] == sentence[k - 1 :]
            buckets.append(_mix(h + np.uint64(k))[same])
            owners.append(sentence[: n - k + 1][same])
    # Words and word pairs; a CJK character is a word by itself.
    inside = word[codes]
    head = (inside & ~np.append(False, inside[:-1])) | single[codes] | (inside & start)
    at = np.flatnonzero(head)
    words = 0
    if len(at):
        token = inside | single[codes]
        part = np.cumsum(head) - 1
        place = np.arange(n) - at[np.maximum(part, 0)]
        power = np.uint64(0x5851F42D4C957F2D) ** np.minimum(place, 40).astype(np.uint64)
        wordhash = np.add.reduceat(np.where(token, value * (power * np.uint64(2) + np.uint64(1)), np.uint64(0)), at)
        owner = sentence[at]
        buckets.append(_mix(wordhash + np.uint64(101)))
        owners.append(owner)
        if len(at) > 1:
            same = owner[1:] == owner[:-1]
            buckets.append(_mix(wordhash[:-1] * np.uint64(0x100000001B3) + wordhash[1:] + np.uint64(202))[same])
            owners.append(owner[1:][same])
        words = np.bincount(owner, minlength=count)
    # Length classes: words, mean word length, commas, by kind of script.
    words = words if isinstance(words, np.ndarray) else np.zeros(count, np.int64)
    cjk = np.add.reduceat(single[codes].astype(np.int64), begin) * 2 > ink
    commas = np.add.reduceat(np.isin(codes, [0x2C, 0xFF0C, 0x3B, 0xFF1B, 0x3001]).astype(np.int64), begin)
    mean = ink / np.maximum(words, 1)
    for k, x in enumerate((np.log2(words + 1) * 2, np.minimum(mean, 12) * 1.5, np.minimum(commas, 8))):
        buckets.append(_mix((x.astype(np.uint64) * np.uint64(4) + cjk.astype(np.uint64) * np.uint64(2)) * _SEED + np.uint64(1000 + k)))
        owners.append(np.arange(count))
    return Sentences(buckets, owners, text, ink)


@dataclass
class Features:
    """Hashed features of many sentences, one sentence after the other: those of sentence k are bucket[at[k]:at[k + 1]]."""

    bucket: np.ndarray
    at: np.ndarray
    text: np.ndarray
    size: np.ndarray


def features(texts: list[str]) -> Features:
    """sentences(), some texts at a time: four bytes a feature are all that is held of texts of any total length."""
    buckets, lengths, owners, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) <= PASS_CHARS):
            chars += len(texts[b])
            b += 1
        s = sentences(texts[a:b])
        if len(s.text):
            owner = np.concatenate(s.owners)
            buckets.append(np.concatenate(s.buckets)[np.argsort(owner, kind="stable")])
            lengths.append(np.bincount(owner, minlength=len(s.text)))
        owners.append(s.text + a)
        sizes.append(s.size)
        a = b
    return Features(np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(owners), np.concatenate(sizes))


class LevelModel:
    """Sentence model and document calibration."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, calibration: np.ndarray) -> None:
        self.weights, self.bias, self.calibration = weights.astype(np.float32), bias.astype(np.float32), calibration

    def sentence_levels(self, s: Sentences) -> np.ndarray:
        """Distribution over the levels of each sentence."""
        count = len(s.text)
        score, features = np.zeros((count, LEVELS), np.float64), np.zeros(count)
        for bucket, owner in zip(s.buckets, s.owners):
            if len(bucket):
                at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                score[owner[at]] += np.add.reduceat(self.weights[bucket], at, axis=0)
                features[owner[at]] += np.diff(np.append(at, len(owner)))
        return _softmax(score / np.sqrt(np.maximum(features, 1))[:, None] + self.bias)

    def levels_of(self, s: Features) -> np.ndarray:
        """sentence_levels of many sentences, a slice of features at a time."""
        count = len(s.text)
        score, a = np.zeros((count, LEVELS)), 0
        length = np.diff(s.at)
        while a < count:
            b = max(a + 1, int(np.searchsorted(s.at, s.at[a] + SLICE_FEATURES, "right")) - 1)
            some = a + np.flatnonzero(length[a:b])
            if len(some):
                score[some] = np.add.reduceat(self.weights[s.bucket[s.at[a] : s.at[b]]], s.at[some] - s.at[a], axis=0)
            a = b
        return _softmax(score / np.sqrt(np.maximum(length, 1))[:, None] + self.bias)

    def profile(self, s: Sentences | Features, levels: np.ndarray, texts: int) -> np.ndarray:
        """A document's sentence distributions in one row: means by length and by sentence, and the share of text at each level."""
        size = s.size.astype(np.float64)
        hard = np.eye(LEVELS)[levels.argmax(1)] if len(levels) else np.zeros((0, LEVELS))
        columns = [np.stack([np.bincount(s.text, w * x[:, k], texts) for k in range(LEVELS)], 1) for x, w in ((levels, size), (hard, size), (levels, (size > 0) * 1.0), (np.log(levels + 1e-3), size))]
        weight = [np.bincount(s.text, w, texts)[:, None] for w in (size, size, (size > 0) * 1.0, size)]
        return np.concatenate([c / np.maximum(w, 1e-9) for c, w in zip(columns, weight)], 1)

    def calibrated(self, profile: np.ndarray) -> np.ndarray:
        return _softmax(np.concatenate([profile, np.ones((len(profile), 1))], 1) @ self.calibration)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return e / e.sum(1, keepdims=True) if len(x) else x


def _fit_sentences(s: Features, target: np.ndarray, epochs: int, seed: int, batch: int = 256, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial regression of sentence levels on hashed features by AdaGrad with L2 shrinkage."""
    bucket, at = s.bucket, s.at
    scale = 1 / np.sqrt(np.maximum(np.diff(at), 1))
    w, g2 = np.zeros((1 << BITS, LEVELS), np.float32), np.full((1 << BITS, 1), 1e-2, np.float32)
    bias = np.zeros(LEVELS)
    rng = np.random.default_rng(seed)
    use = np.flatnonzero(np.diff(at) > 0)
    for _ in range(epochs):
        rng.shuffle(use)
        for k in range(0, len(use), batch):
            rows = use[k : k + batch]
            lens = at[rows + 1] - at[rows]
            pick = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            b = bucket[pick]
            begins = np.concatenate([[0], np.cumsum(lens)[:-1]])
            score = np.add.reduceat(w[b], begins, axis=0) * scale[rows][:, None] + bias
            error = (_softmax(score) - target[rows]).astype(np.float32)
            bias -= 0.05 * error.mean(0)
            slope = np.repeat(error * scale[rows][:, None].astype(np.float32), lens, axis=0)
            by = np.argsort(b, kind="stable")
            sb = b[by]
            edge = np.flatnonzero(np.append(True, sb[1:] != sb[:-1]))
            which, total = sb[edge], np.add.reduceat(slope[by], edge, axis=0)
            total += decay * len(use) / batch * w[which]
            g2[which] += (total**2).mean(1, keepdims=True)
            w[which] -= rate * total / np.sqrt(g2[which])
    return w, bias


def _fit_calibration(profile: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 600) -> np.ndarray:
    """Ridge multinomial regression of document levels on sentence profiles."""
    x = np.concatenate([profile, np.ones((len(profile), 1))], 1)
    w = np.zeros((x.shape[1], LEVELS))
    step, speed = 1.0 / (0.5 * np.linalg.norm(x, 2) ** 2 / len(x) + ridge), np.zeros_like(w)
    for k in range(steps):
        ahead = w + k / (k + 3) * speed
        new = ahead - step * (x.T @ (_softmax(x @ ahead) - target) / len(x) + ridge * ahead)
        speed, w = new - w, new
    return w


def fit(texts: list[str], grades: np.ndarray, epochs: int = 3, seed: int = 7) -> LevelModel:
    """Sentence model of graded texts, without calibration; grades has a row per text with the shares of its gradings at each level.

    After a first fit, sentence targets are the document's grade tempered by the model's own view of the
    sentence, so that sentences of another level than their document's do not teach its level.
    """
    blank = np.zeros((4 * LEVELS + 1, LEVELS))
    s = features(texts)
    given = grades[s.text]
    model = LevelModel(*_fit_sentences(s, given, epochs, seed), blank)
    near = given @ (np.eye(LEVELS) * 0.7 + 0.1 * (np.abs(np.subtract.outer(range(LEVELS), range(LEVELS))) == 1) + 0.05)
    mixed = model.levels_of(s) * near
    return LevelModel(*_fit_sentences(s, mixed / mixed.sum(1, keepdims=True), epochs, seed), blank)


def _fit_role(rows: pa.Table) -> pa.Table:
    """One of the fits over the sample: for a fold, profiles of its documents by a model of the others; for role FOLDS, the model of all."""
    rows = rows.sort_by("doc_id")
    role = rows.column("role")[0].as_py()
    texts, grades = rows.column("text").to_pylist(), np.array(rows.column("grades").to_pylist(), np.float64)
    grades /= np.maximum(grades.sum(1, keepdims=True), 1)
    if role == FOLDS:
        model = fit(texts, grades)
        out = [("weights", None, model.weights.tobytes()), ("bias", None, model.bias.tobytes())]
    else:
        held = np.arange(len(texts)) % FOLDS == role
        model = fit([t for t, h in zip(texts, held) if not h], grades[~held])
        s = features([t for t, h in zip(texts, held) if h])
        profiles = model.profile(s, model.levels_of(s), int(held.sum()))
        out = [("profile", grade.tobytes(), p.tobytes()) for grade, p in zip(grades[held], profiles)]
    return pa.table({"what": [o[0] for o in out], "grade": pa.array([o[1] for o in out], pa.binary()), "value": pa.array([o[2] for o in out], pa.binary())})


_INK = r"[^\s\p{Z}\p{Cf}]"


def graded_sample(documents: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS, characters: int = TRAINING_CHARACTERS) -> DataFrame:
    """(doc_id, text, grades ARRAY<BIGINT>): graded documents with text and how many gradings each level has.

    At most ``most`` of them, by hashed id, and only so many that those before the last hold fewer than
    ``characters``; texts are whole. Of a repeated doc_id one text counts.
    """
    counts = [F.count_if(F.col("reading_level") == k).alias(f"g{k}") for k in range(1, LEVELS + 1)]
    grades = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(*counts).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` ids are broadcast, and only their texts are looked at.
    found = documents.select("doc_id", "text").join(F.broadcast(grades.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.max(F.when(F.col("text").rlike(_INK), F.col("text"))).alias("text")).where("text is not null")
    sample = written(found.join(grades, "doc_id").select("doc_id", "text", F.array(*[f"g{k}" for k in range(1, LEVELS + 1)]).alias("grades")))
    # One window over at most ``most`` rows of two numbers.
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    kept = sample.select("doc_id", F.length("text").cast("bigint").alias("size")).withColumn("before", before).where(F.coalesce("before", F.lit(0)) < characters)
    return sample.join(F.broadcast(kept.select("doc_id")), "doc_id", "left_semi")


def train(sample: DataFrame) -> LevelModel | None:
    """Model of a graded sample; None for fewer than two documents.

    Each fit is a task on the executors. What comes back to the driver is bounded by the sample's documents
    and the model's size: some numbers a document, and some megabytes of weights.
    """
    # Twice as many partitions as roles: so each role has a task of its own.
    roles = sample.withColumn("role", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartition(2 * (FOLDS + 1), "role")
    rows = roles.groupBy("role").applyInArrow(_fit_role, "what string, grade binary, value binary").collect()
    held = [(np.frombuffer(r["grade"]), np.frombuffer(r["value"])) for r in rows if r["what"] == "profile"]
    if len(held) < 2:
        return None
    of = {r["what"]: np.frombuffer(r["value"], np.float32) for r in rows if r["what"] != "profile"}
    held.sort(key=lambda x: x[1].tobytes())  # rows come back in no order
    return LevelModel(of["weights"].reshape(-1, LEVELS), of["bias"], _fit_calibration(np.stack([p for _, p in held]), np.stack([g for g, _ in held])))


def reading_levels(documents: DataFrame, labels: DataFrame, kinds: tuple[str, ...] = PROSE_KINDS, training_documents: int = TRAINING_DOCUMENTS, training_characters: int = TRAINING_CHARACTERS) -> DataFrame:
    """(doc_id, level INT, demanding DOUBLE, shares ARRAY<DOUBLE>) of every document of the given kinds that has text.

    level is the most likely level of the whole text, demanding the probability of DEMANDING and above,
    shares the mean distribution of its sentences. Null, empty and blank texts and other kinds give no row;
    repeated rows stay repeated. Models are fitted, while the plan is built, on at most ``training_documents``
    graded documents of some ``training_characters`` together; with fewer than two there is no model and no
    row. Texts are used whole, whatever their length.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, level int, demanding double, shares array<double>"
    spark = documents.sparkSession
    trained = train(graded_sample(documents, labels, training_documents, training_characters))
    if trained is None:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(trained)  # some megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("text").to_pylist()
            a = 0
            while a < len(whole):
                b, chars = a, 0
                while b < len(whole) and (b == a or chars + len(whole[b]) <= PASS_CHARS):
                    chars += len(whole[b])
                    b += 1
                s = sentences(whole[a:b])
                profile = model.value.profile(s, model.value.sentence_levels(s), b - a)
                p = model.value.calibrated(profile)
                shares = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * LEVELS + 1, LEVELS), pa.int32()), pa.array(profile[:, :LEVELS].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array((p.argmax(1) + 1).astype(np.int32)), pa.array(p[:, DEMANDING - 1 :].sum(1)), shares],
                    names=["doc_id", "level", "demanding", "shares"],
                )
                a = b

    rows = documents.where(F.col("kind").isin(*kinds) & F.col("text").rlike(_INK)).select("doc_id", "text")
    return rows.mapInArrow(run, schema)
