"""Spelling variants: words one edit apart, found by exact PartEnum signatures of their letters.

A word is read as a multiset of letters, a binary vector with a place for every (letter, occurrence). One replaced letter changes two
places, an inserted or deleted one changes one, so near words have vectors at Hamming distance two at most. Letters are dealt to
`first` parts and each of these to `second` parts; of the first parts one holds at most (K + 1) / first - 1 (rounded up) of the
changes, and all but so many of its second parts are equal on both sides. Every word therefore emits, for every first part and every
choice of so many second parts, the letters they hold as one signature; words that share none are never near. Signatures meet in
equi-joins and every pair is verified by edit distance.

Few letters left in a signature can bring many words together. Words of a signature with over CROWD words meet under it only
together with a half of the word: of two words one edit apart, with the shorter of m letters, either the first m // 2 letters or the
last m - m // 2 are equal. This loses no pair, and no signature's words are all held against each other.

Tables here grow with the vocabulary, and Spark takes an exploded one for as small as the file it comes from. Joins are therefore
merge joins by hint: none is broadcast, so none passes through the driver.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed values of the contract: runs of letters, the share of runs that lose a letter, the least length and count of a word, the ratio of a form.
RUN, EVERY, LEAST_LENGTH, LEAST_COUNT, RATIO = "[A-Za-zÀ-ÿ]+", 199, 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hamming distance of the vectors, and the parts that letters are dealt to.
K, FIRST, SECOND = 2, 1, 6
#: Words of a signature beyond which they meet under halves of the word too.
CROWD = 64


def word_counts(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of docs(doc_id, text) with enough letters and occurrences.

    A word is a maximal run of letters with A-Z lower-cased. If `every` divides the crc32 of `<doc_id>:<run>`, the run's letter number
    crc32 % length is deleted. Counts are summed map-side first, so a word of a third of all rows is one row a task. Null texts have no
    words, a null doc_id is written as nothing before the colon; repeated rows count again. Other columns are not read.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    run = found.where(F.length("run") >= least_length).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = run.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return word.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def signatures(word: Column, k: int = K, first: int = FIRST, second: int = SECOND) -> Column:
    """array<long>: hashes of the PartEnum signatures of a word's multiset of letters, for vectors at Hamming distance k at most."""
    inside = math.ceil((k + 1) / first) - 1  # changes in the first part that holds fewest
    if not 1 <= first <= k + 1 or second <= inside:
        raise ValueError("the parts cannot hold that many changes")
    letters = F.array_sort(F.split(word, ""))
    part = lambda i: F.array_join(F.filter(letters, lambda c: F.ascii(c) % (first * second) == i), "")
    out = []
    for f in range(first):
        for chosen in combinations(range(f * second, (f + 1) * second), second - inside):
            out.append(F.xxhash64(F.lit(len(out)), *(part(i) for i in chosen)))
    return F.array(*out)


def _halves(word: Column) -> Column:
    """The keys under which a word meets those one edit away: for m its own length or one less, the first m // 2 letters and the last m - m // 2."""
    out, size = [], F.length(word)
    for m in (size, size - 1):
        half = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(m, F.lit("first"), F.substring(word, F.lit(1), half)))
        out.append(F.xxhash64(m, F.lit("last"), F.substring(word, size - (m - half) + 1, m - half)))
    return F.array(*out)


def near_pairs(words: DataFrame, crowd: int = CROWD, k: int = K, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct words of words(word) that differ by exactly one inserted, deleted or replaced code point, once each."""
    signed = words.select("word", F.explode(signatures(F.col("word"), k, first, second)).alias("sig"))
    crowds = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    some = signed.join(crowds.hint("merge"), "sig")
    few = some.where(F.col("size") <= crowd).select("sig", F.lit(0).cast("long").alias("half"), "word")
    many = some.where(F.col("size") > crowd).select("sig", F.explode(_halves(F.col("word"))).alias("half"), "word")
    keyed = few.unionByName(many)
    a, b = keyed.select("sig", "half", F.col("word").alias("a")), keyed.select("sig", "half", F.col("word").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b.hint("merge"), ["sig", "half"]).where(close).select("a", "b").distinct()


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) for forms(word, form): the last word of each chain of forms, by doubling the steps of all chains at once.

    Every step multiplies the count by `ratio`, so a chain has at most log_ratio(most) steps and the rounds are known before.
    """
    steps = max(1, math.ceil(math.log(max(most, ratio), ratio)))
    jump = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = written(jump.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return jump


def spelling_variants(docs: DataFrame, ratio: int = RATIO, **counts) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs: see word_counts, near_pairs and roots.

    form is the near word of the largest n (ties: the smallest in code-point order) if that n is at least `ratio` times the word's own, else
    null with a null form_n; root is the end of the chain of forms, the word itself without one. No words give an empty table.
    """
    words = written(word_counts(docs, **counts), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b"), F.col("a")))
    best = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    joined = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    takes = F.col("near_n") >= F.col("n") * ratio
    rated = written(joined.select("word", "n", "n_near", F.when(takes, F.col("near")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1  # one number
    chains = roots(rated.where("form is not null"), most, ratio)
    return rated.join(chains.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE: dict[str, str] = {}
