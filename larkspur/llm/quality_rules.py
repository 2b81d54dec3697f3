"""Quality rules, line first: lines that fail a rule go, then documents that lose too much of their text.

All of it is one projection of built-in functions over each document's own row: no shuffle, no Python.

Line rules (a line without a word is neither kept nor counted):

* navigation: more than one ``|``, or one of ``« » › ‹ →``, for every four words;
* symbols: more than one character of ``[#*$%&|<>]`` for every three words;
* shouting: more than one ``!!`` for every three words, or four words and more all in capitals;
* punctuation: fewer than eight words and no closing punctuation at the end;
* boilerplate: one of BOILERPLATE stands in it.

A document is kept if it passes the base rules (ten words at least; at most 20 % of the words in repeated
windows of five) and at least half of its word characters stand in lines that pass.

Results for odd rows: null and empty texts have zero counts and fail; repeated rows give repeated results;
texts of any length are read whole.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE_RUN, SPACES, fresh, slim, words_of

#: Phrases of boilerplate, lower case.
BOILERPLATE = (
    "all rights reserved",
    "this work is licensed",
    "licensed under the",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "powered by",
    "lorem ipsum",
)
WINDOW, LEAST_WORDS, MOST_REPEATED, LEAST_KEPT = 5, 10, 20, 50
SYMBOLS = r"[#*$%&|<>]"


def count_of(text: Column, literal: str) -> Column:
    return F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit(""))), F.lit(len(literal)))


def passing(lines: Column, boilerplate: tuple[str, ...] = BOILERPLATE) -> Column:
    """The lines, each with at least one word, that pass every line rule."""
    counted = F.transform(lines, lambda x: F.struct(x.alias("line"), (F.regexp_count(F.btrim(x, F.lit(SPACES)), F.lit(SPACE_RUN)) + 1).alias("words"), F.regexp_count(x, F.lit(SYMBOLS)).alias("symbols")))

    def passes(x: Column) -> Column:
        line, words = x["line"], x["words"]
        symbols = 3 * x["symbols"] > words
        navigation = (F.contains(line, F.lit("|")) | line.rlike("[«»‹›→]")) & (4 * F.regexp_count(line, F.lit("[|«»‹›→]")) > words)
        shouting = (F.contains(line, F.lit("!!")) & (3 * count_of(line, "!!") > words)) | ((words >= 4) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
        unclosed = (words < 8) & ~line.rlike(r"""[.!?…:;。！？]["'”’»)\]]*[\x20\x09-\x0D]*$""")
        lowered = F.lower(line)
        stale = reduce(or_, [F.contains(lowered, F.lit(b)) for b in boilerplate], F.lit(False))
        return ~(symbols | navigation | shouting | unclosed | stale)

    return F.transform(F.filter(counted, lambda x: passes(x)), lambda x: x["line"])


def measured(docs: DataFrame, boilerplate: tuple[str, ...] = BOILERPLATE, least_kept: int = LEAST_KEPT) -> tuple[DataFrame, dict[str, str]]:
    """docs with the counts, verdicts and the text of the lines that pass, in new columns; and what those are called."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "words", "hashes", "sorted", "repeats", "lines", "passed")
    own = dict(zip(names, fresh(docs, *names)))
    text, c = F.coalesce(F.col("`text`"), F.lit("")), {k: F.col(f"`{v}`") for k, v in own.items()}
    df = docs.withColumns({own["words"]: words_of(text), own["lines"]: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size(c["words"])
    df = df.withColumns({
        own["n_words"]: n.cast("long"),
        own["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
        own["n_symbols"]: F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        own["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        own["passed"]: F.array_join(passing(c["lines"], boilerplate), "\n"),
        own["hashes"]: F.transform(c["words"], lambda w: F.xxhash64(w)),
    })
    df = df.withColumn(own["hashes"], F.when(c["n_words"] >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(c["hashes"]) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(c["hashes"], i, WINDOW)))))
    # only a text with a window that comes back has its windows sorted; equal ones then stand side by side
    df = df.withColumn(own["sorted"], F.when(F.size(F.array_distinct(c["hashes"])) < F.size(c["hashes"]), F.sort_array(F.transform(c["hashes"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.get(c["sorted"], j)["h"] == x["h"]
    df = df.withColumn(own["repeats"], F.sort_array(F.array_compact(F.transform(c["sorted"], lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"])))))
    covered = F.aggregate(F.transform(c["repeats"], lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(c["repeats"], j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(own["n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long"))
    df = df.withColumn(own["base_failed"], (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"]))
    passed_chars = F.length(F.translate(c["passed"], SPACES, ""))
    df = df.withColumns({own["kept"]: ~c["base_failed"] & (100 * passed_chars >= least_kept * c["word_chars"]), own["clean_text"]: c["passed"]})
    return df.drop(*[own[k] for k in ("words", "hashes", "sorted", "repeats", "lines", "passed")]), own


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and clean_text (the lines that pass)."""
    df, own = measured(slim(docs, "doc_id", "text"))
    return df.select("doc_id", *[F.col(own[k]).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")])


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their failing lines removed and n_chars (if there is one) counted again; the columns of docs."""
    df, own = measured(docs)
    # the filter reads a number of the row that is never negative: Spark then evaluates the rules once, below the filter,
    # where it would otherwise put the whole rules in place of each column that the condition names
    (number,) = fresh(df, "row_number")
    df = df.withColumn(number, F.monotonically_increasing_id())
    text = F.col(f"`{own['clean_text']}`")
    out = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return df.where(F.col(f"`{own['kept']}`") & (F.col(number) >= 0)).select(*[(out[c].alias(c) if out.get(c) is not None else F.col(f"`{c}`")) for c in docs.columns])
