"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a run of at least LEAST characters of ``[A-Za-z0-9_+/.~-]`` that holds a digit or changes case
inside, or a shorter one of at least LEAST_ASSIGNED characters, letters and digits, that a name is assigned to
(``name = value``, ``name: value``). What the forest sees of it: its length, how often neighbouring characters
change between letters, digits and marks and between cases, its entropy, the share of it that dictionary words
cover, whether it stands in a path, and the words next to it. The forest is trained (Spark ML) on labelled
findings; the sample of them has a documented bound, and everything else covers all rows.

Findings without labels of their own are labelled by `weak_label`, from what stands before them and from public
formats of keys: a value assigned to the name of a credential, or of such a format, is a secret; card numbers,
addresses, mail addresses, words, numbers and values of other names are not; the rest has none. A forest trained on
those does not see what the labels were made from (the assignment, quotes, cues), only the string's shape and its
other neighbours (SHAPE); one trained on given labels sees all FEATURES.

Results for odd rows: null and empty texts have no candidate; repeated rows give repeated results, repeated labels
count once; a null doc_id is an id; if the labels have one class only, all findings get it, and without any label no
finding is kept; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.bpe import read_vocabulary
from larkspur.llm.common import in_parts, saved, slim

LEAST, LEAST_ASSIGNED = 16, 6
#: Labelled findings that the forest is trained on, at most.
MOST_LABELLED = 20_000
CANDIDATE = re.compile(r"[A-Za-z0-9_+/.~-]{%d,}={0,2}" % LEAST)
ASSIGNED = re.compile(r"[A-Za-z_][\"']?\s?[:=]\s?[\"']?([A-Za-z0-9_+/.~-]{%d,%d})(?![A-Za-z0-9_+/.~=-])" % (LEAST_ASSIGNED, LEAST - 1))
#: Public formats of keys (fixed values).
FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+")
CUES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private")
#: Names of credentials that, with an assignment, label a finding.
NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key|credential|auth)[\"']?\s*[:=]+\s*[\"']?$")
SHAPE = ("length", "class_changes", "case_changes", "digit_share", "entropy", "coverage", "path", "known_before", "known_after")
FEATURES = (*SHAPE, "assigned", "quoted", "cue", "cue_distance")


def classes_of(s: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.isalpha() else 2 for c in s]


def coverage(s: str, words: frozenset[str], longest: int) -> float:
    """The share of the characters that stand in dictionary words of four letters and more, longest first from the left."""
    s, at, covered = s.lower(), 0, 0
    while at < len(s):
        for n in range(min(longest, len(s) - at), 3, -1):
            if s[at : at + n] in words:
                covered += n
                at += n
                break
        else:
            at += 1
    return covered / len(s)


def features(text: str, start: int, end: int, words: frozenset[str], longest: int) -> list[float]:
    s = text[start:end]
    kinds, n = classes_of(s), len(s)
    counts = [s.count(c) / n for c in set(s)]
    before = text[max(0, start - 60) : start]
    near = re.findall(r"[a-z_]+", before.lower())[-4:][::-1]
    after = re.findall(r"[A-Za-z]+", text[end : end + 60])[:4]
    known = lambda some: sum(w.lower() in words for w in some) / max(1, len(some))
    cue = next((i + 1 for i, w in enumerate(near) if any(c in w for c in CUES)), 0)
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a.islower() != b.islower() and a.isalpha() and b.isalpha() for a, b in zip(s, s[1:])) / n,
        kinds.count(0) / n,
        -sum(p * math.log2(p) for p in counts),
        coverage(s, words, longest),
        float("/" in s or before.endswith(("/", "\\")) or bool(re.search(r"\.[a-z]{2,4}$", s))),
        known(near),
        known(after),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before.endswith(('"', "'")) and text[end : end + 1] in ('"', "'")),
        float(cue > 0),
        float(cue),
    ]


def weak_label(text: str, start: int, end: int) -> int | None:
    s, before = text[start:end], text[max(0, start - 60) : start]
    if NAMED.search(before) or FORMATS.fullmatch(s):
        return 1
    if len(s) < LEAST and re.search(r"[:=]\s?[\"']?$", before):
        return 0
    if re.fullmatch(r"[\d.+/=_-]+", s) or re.fullmatch(r"[A-Za-z.\-/]+", s) or text[end : end + 1] == "@" or text[start - 1 : start] == "@" or "://" in text[max(0, start - 8) : start]:
        return 0
    return None


def found(text: str) -> list[tuple[int, int]]:
    """Where candidates stand."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".=-")
        if len(s) >= LEAST and (any(c.isdigit() for c in s) or re.search("[a-z][A-Z]", s)):
            out.append((m.start(), m.start() + len(s)))
    for m in ASSIGNED.finditer(text):
        if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
            out.append(m.span(1))
    return sorted(out)


def dictionary(path: str) -> frozenset[str]:
    """Lower-case words of four letters and more from a public vocabulary file (of checked size)."""
    return frozenset(w for t in json.loads(read_vocabulary(path))["model"]["vocab"] if len(w := t.lstrip("Ġ").lower()) >= 4 and w.isascii() and w.isalpha())


def findings(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """One row per candidate: doc_id, text_hash, start, end, label (weak, may be null) and the FEATURES."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(words)
    longest = max(map(len, words), default=4)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.DoubleType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])

    def run(batches):
        known = shared.value
        for batch in in_parts(batches):
            ids, hashes, out = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for s, e in found(text or ""):
                    ids.append(k)
                    out.append((s, e, weak_label(text, s, e), *features(text, s, e, known, longest)))
            if ids:
                take = pa.array(ids)
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * (1 + len(FEATURES))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array([r[k] if r[k] is None else (int if k < 2 else float)(r[k]) for r in out], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(labelled: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 20, depth: int = 6, seed: int = 11):
    """A forest from findings with a label; a constant if there is one class, None without labels. At most about MOST_LABELLED findings, drawn by a hash."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = labelled.where("label IS NOT NULL")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows at most
    if len(kinds) < 2:
        return next(iter(kinds), None)
    drawn = int(min(1.0, MOST_LABELLED / sum(kinds.values())) * (1 << 30))
    sample = saved(labelled.where(F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.lit(1 << 30)) < drawn))
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample)
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability").fit(ready)


def judged(candidates: DataFrame, model, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """The candidates with is_secret and score."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model is None or isinstance(model, float):
        return candidates.withColumns({"score": F.lit(float(model or 0.0)), "is_secret": F.lit(bool(model))})
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(candidates)
    return model.transform(ready).withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, vocabulary: str, labels: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets, spans (start:end of each secret, by start).

    labels: findings (doc_id, start, end, label) that take the place of weak labels.
    """
    docs = slim(docs, "doc_id", "text")
    candidates = saved(findings(docs, dictionary(vocabulary)))
    known, seen = candidates, SHAPE
    if labels is not None:
        given = labels.groupBy(F.col("doc_id").alias("of"), F.col("start").alias("from"), F.col("end").alias("upto")).agg(F.max("label").cast("double").alias("label"))
        known, seen = candidates.drop("label").join(given, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("start") == F.col("from")) & (F.col("end") == F.col("upto"))), FEATURES
    marked = judged(candidates, train(known, seen), seen).select("doc_id", "text_hash", "start", "end", "is_secret").distinct()
    secret = F.when(F.col("is_secret"), F.struct("start", "end"))
    per_doc = marked.groupBy(F.col("doc_id").alias("d"), "text_hash").agg(F.count(F.lit(1)).alias("n_candidates"), F.sort_array(F.collect_list(secret)).alias("found"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = ids.join(per_doc, ids["doc_id"].eqNullSafe(per_doc["d"]) & (ids["text_hash"] == per_doc["text_hash"]), "left")
    return joined.select(ids["doc_id"], F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.size(F.coalesce("found", F.array().cast("array<struct<start:bigint,end:bigint>>"))).cast("long").alias("n_secrets"), F.coalesce(F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["start"], x["end"])), ","), F.lit("")).alias("spans"))
