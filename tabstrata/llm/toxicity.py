"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Labelled training rows are split by hash into three parts. From the first a lexicon of words and
word beginnings is learned by their log odds in toxic documents; on the second, trees are grown
over dense features (lexicon densities, hits near a second person, capitals, punctuation,
obfuscation); on the third, isotonic regression maps the trees' margins to probabilities.

Scale: fitting uses a bounded sample of labelled rows (``max_rows``, least hashes of the id first), whose ids are
broadcast, so texts are not shuffled; scoring is one pass of the texts to eleven numbers, and the
trees and the calibration then run in the JVM. Without rows of both classes every score is the
share of toxic labels (0 without labels).

Cases: null and empty texts have all features 0 and get a score; null labels are not learned from;
an id labelled twice is learned from twice; repeated rows get equal scores; other columns
are kept, but for those named like a feature or ``toxicity``, which give way to the results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabstrata.llm.common import bounded_batches, one
from tabstrata.runtime import materialize

#: Labelled rows used for fitting, and terms kept in the lexicon.
MAX_ROWS, MAX_TERMS = 30_000, 4_000
#: Length of the word beginnings that stand in the lexicon beside whole words.
STEM = 5
FEATURES = (
    "length", "hits", "hit_rate", "weight_rate", "top_window", "near_you", "capitals", "shouting",
    "marks", "punctuation", "obfuscated",
)
#: Fixed list: second persons of the languages in the tables.
SECOND_PERSON = frozenset(
    w.encode()
    for w in (
        "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
        "sie ihnen tú ti usted ustedes vosotros su sus"
    ).split()
)
#: Digits and signs read as letters, and all that parts words as blanks; letters in lower case.
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_READ = bytes(
    ord(_LOOKS[chr(c)]) if chr(c) in _LOOKS else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
    for c in range(256)
)
_HIDING = re.compile(rb"[A-Za-z][0-9@$*]+[A-Za-z]|\b[A-Za-z](?:[.\-_ *][A-Za-z]){3,}\b")
_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 small letter, 3 ! or ?, 4 other punctuation
_CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 2
_CLASS[[33, 63]] = 3
_CLASS[[c for c in range(34, 127) if not chr(c).isalnum() and c != 63]] = 4


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_READ).split()


class Lexicon:
    """Log odds of words and of word beginnings."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float]):
        self.words, self.stems = words, stems

    def features(self, text: bytes) -> list[float]:
        words = words_of(text)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        lookup, stem = self.words.get, self.stems.get
        hits = [(i, lookup(w) or stem(w[:STEM])) for i, w in enumerate(words)]
        hits = [(i, x) for i, x in hits if x]
        top = near = 0
        a = 0
        for b, (i, _) in enumerate(hits):
            while hits[a][0] < i - 49:
                a += 1
            top = max(top, b - a + 1)
            near += not SECOND_PERSON.isdisjoint(words[max(0, i - 3) : i + 4])
        kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=5)
        letters = max(int(kinds[1] + kinds[2]), 1)
        shouting = sum(w.isupper() and len(w) > 2 for w in text.split()) / n if kinds[1] > 0.1 * letters else 0.0
        return [
            float(np.log1p(n)), float(len(hits)), len(hits) / n, sum(x for _, x in hits) / n, float(top), near / n,
            kinds[1] / letters, shouting, kinds[3] / n, kinds[4] / n, len(_HIDING.findall(text)) / n,
        ]


def _terms(rows: DataFrame) -> DataFrame:
    """(term, pos, neg): in how many toxic and other texts a word ("w...") or beginning ("s...") stands."""

    def task(batches):
        counts: dict[bytes, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(words_of((text.as_py() or "").encode()))
                found = {b"w" + w for w in words} | {b"s" + w[:STEM] for w in words if len(w) > STEM}
                for t in found:
                    counts.setdefault(t, [0, 0])[0 if label else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(counts), pa.binary()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64()),
            ],
            names=["term", "pos", "neg"],
        )

    counted = rows.select("text", "toxic").mapInArrow(task, "term binary, pos bigint, neg bigint")
    return counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(rows: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """The terms most telling of toxic texts, at most ``max_terms`` by evidence."""
    size = one(rows.agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")))
    rate = ((F.col("pos") + 0.5) / (size["pos"] + 1.0)) / ((F.col("neg") + 0.5) / (size["neg"] + 1.0))
    least = max(3, size["pos"] // 1000)
    telling = _terms(rows).withColumn("odds", F.log(rate)).where(f"pos >= {least} and odds > 2")
    kept = telling.orderBy(F.desc(F.col("pos") * F.col("odds")), "term").limit(max_terms).collect()
    words, stems = {}, {}
    for r in kept:
        (words if bytes(r["term"])[:1] == b"w" else stems)[bytes(r["term"])[1:]] = r["odds"]
    return Lexicon(words, stems)


def dense(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without ``text``, plus the columns of ``FEATURES``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(f, T.DoubleType()) for f in FEATURES])

    def task(batches):
        lexicon = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("").cast(pa.binary())
            rows = np.array([lexicon.features(t.as_py()) for t in texts]).reshape(batch.num_rows, len(FEATURES))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in rows.T.copy()]], names=[*names, *FEATURES])

    return docs.mapInArrow(task, schema)


def sample(labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, toxic, part): at most ``max_rows`` labelled rows, and the part (0, 1, 2) each is used for."""
    rows = labels.where(learn & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    hashed = F.xxhash64(F.lit(11), "__id")
    rows = rows.orderBy(hashed, "toxic").limit(max_rows)
    fifth = F.pmod(F.xxhash64(F.lit(12), "__id"), F.lit(5))
    return rows.withColumn("part", F.when(fifth < 2, 0).when(fifth < 4, 1).otherwise(2))


def score(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without ``text``, plus ``toxicity`` (0 to 1), in place of a column of this name, and the struct ``features``,
    unless ``docs`` has a column of that name; all other columns come back untouched, whatever their names.

    ``learn`` is a condition on ``doc_id`` that says which labels may be learned from.
    """
    docs = bounded_batches(docs).drop("toxicity")
    kept = [c for c in docs.columns if c != "text"]
    back = [F.col(f"__in_{i}").alias(c) for i, c in enumerate(kept)]
    if "features" not in kept:
        back.append(F.struct(*FEATURES).alias("features"))
    # columns are carried under other names, so that none is taken for a feature
    carried = docs.select("text", *[F.col(c).alias(f"__in_{i}") for i, c in enumerate(kept)])
    chosen = materialize(sample(labels, learn, max_rows), "sample")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    texts = materialize(texts.select("text", "toxic", "part"), "labelled")
    size = one(texts.agg(F.avg("toxic").alias("share"), *[
        F.count_if((F.col("part") == p) & (F.col("toxic") == y)).alias(f"n{p}{y}") for p in (0, 1, 2) for y in (0, 1)
    ]))
    lexicon = learn_lexicon(texts.where("part = 0"))
    scored = dense(carried, lexicon)
    if min(size[k] for k in size if k != "share") == 0:
        return scored.select(*back, F.lit(float(size["share"] or 0.0)).alias("toxicity"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
    train = materialize(dense(texts.where("part > 0"), lexicon), "features")
    train = vectors.transform(train).withColumn("toxic", F.col("toxic").cast("double"))
    trees = GBTClassifier(
        labelCol="toxic", featuresCol="__features", maxIter=20, maxDepth=3, stepSize=0.2, seed=5,
        minInstancesPerNode=5, predictionCol="__y",
    )
    trees = trees.setRawPredictionCol("__raw").setProbabilityCol("__p").fit(train.where("part = 1"))
    margin = vector_to_array("__raw")[1]
    held = trees.transform(train.where("part = 2")).select(margin.alias("__margin"), "toxic")
    curve = IsotonicRegression(featuresCol="__margin", labelCol="toxic", predictionCol="toxicity").fit(held)
    out = trees.transform(vectors.transform(scored)).withColumn("__margin", margin)
    return curve.transform(out).select(*back, "toxicity")
