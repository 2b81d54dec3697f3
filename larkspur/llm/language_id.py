"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lowered and every other character counts as a gap; n-grams of one to three characters that
hold a letter are hashed into BUCKETS buckets. Training counts buckets per language over all training
rows, in partial sums per task, so what reaches the driver is at most languages x buckets. The matrix of
log probabilities is broadcast (its size is bounded and checked) and texts are scored in numpy batches:
rows of the matrix are gathered for the n-grams of many texts at once and summed per text.

Results for odd rows: texts that are null or have no letter get ``und`` and score 0; so does every text
if no training row has a language; ties go to the language that sorts first; a null doc_id counts as the
empty text when the held-out part is drawn; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import in_parts, slim

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: The matrix is broadcast: at most this many languages (times BUCKETS times 4 bytes).
MOST_LANGUAGES = 1000
#: Characters that are scored at once.
CHUNK = 1 << 18
UNKNOWN = "und"

_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 for anything that is not a letter."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the texts, and for each the number of its text.

    A text is taken as if a gap stood on either side; two gaps in a row count as one only in that no n-gram of gaps alone is made.
    """
    table = letters()
    code = [table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
    gap = np.zeros(max(ORDERS) - 1, np.uint32)
    flat = np.concatenate([x for c in code for x in (gap, c)] + [gap]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(c) + len(gap) for c in code])])
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    n = int(starts[-1])
    mixed, some, found, who = np.zeros(n, np.uint64), np.zeros(n, bool), [], []
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            part = flat[k : n + k]
            mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (part + np.uint64(k + 1))
            some = some | (part > 0)
            if k + 1 in ORDERS:
                h = mixed * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                found.append((h % np.uint64(BUCKETS)).astype(np.int32)[some])
                who.append(owner[some])
    return np.concatenate(found), np.concatenate(who)


def chunks(texts: list[str]):
    """Runs of texts of about CHUNK characters; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def held_out(doc_id: str | Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the crc32 of the id as text leaves this remainder."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


class Model:
    """Log probabilities of buckets per language, and of the languages."""

    def __init__(self, languages: list[str], prior: np.ndarray, likely: np.ndarray):
        self.languages, self.prior, self.likely = languages, prior, likely  # likely: languages x buckets

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b in chunks(texts):
            part = texts[a:b]
            buckets, owners = grams(part)
            sums = np.zeros((len(part), len(self.languages))) + self.prior
            for j in range(len(self.languages)):
                sums[:, j] += np.bincount(owners, weights=self.likely[j].take(buckets), minlength=len(part))
            empty = np.bincount(owners, minlength=len(part)) == 0
            for i in range(len(part)):
                if empty[i] or not self.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(sums[i].argmax())
                names.append(self.languages[best])
                scores.append(float(1 / np.exp(sums[i] - sums[i, best]).sum()))
        return names, scores


def train(rows: DataFrame, smoothing: float = 0.5) -> Model:
    """The model of all rows (text, lang) with both; counts are summed in tasks, then per language and bucket."""
    import pyarrow as pa

    rows = slim(rows, "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = "lang string, bucket int, n long, texts long"

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in in_parts(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                texts_of[lang] = texts_of.get(lang, 0) + len(own)
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a, b in chunks(own):
                    total += np.bincount(grams(own[a:b])[0], minlength=BUCKETS)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*total[at].tolist(), 0], pa.int64()), pa.array([0] * len(at) + [texts_of[lang]], pa.int64())], names=["lang", "bucket", "n", "texts"])

    sums = rows.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    per_language = sums.groupBy("lang").agg(F.sum("texts").alias("texts"), F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "n"))).alias("counts"))
    got = per_language.limit(MOST_LANGUAGES + 1).collect()  # at most MOST_LANGUAGES rows of at most BUCKETS counts
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the matrix would be too large to broadcast")
    got.sort(key=lambda r: r["lang"])
    likely = np.zeros((len(got), BUCKETS))
    for j, r in enumerate(got):
        for x in r["counts"]:
            likely[j, x["bucket"]] = x["n"]
    likely = np.log(likely + smoothing) - np.log((likely + smoothing).sum(axis=1, keepdims=True)) if got else likely
    texts = np.array([r["texts"] for r in got], float)
    return Model([r["lang"] for r in got], np.log(texts / texts.sum()) if got else texts, likely.astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the posterior probability of that language)."""
    import pyarrow as pa

    slimmed = slim(docs, "doc_id", "text")
    schema = T.StructType([slimmed.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prior, model.likely))

    def run(batches):
        own = Model(*shared.value)
        for batch in in_parts(batches):
            names, scores = own.score([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return slimmed.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    slimmed = slim(docs, "doc_id", "text", "lang")
    model = train(slimmed.where(~held_out("doc_id")))
    return predict(slimmed, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
