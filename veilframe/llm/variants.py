"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered by how often distinct words have them. A word's prefix is its three rarest bigrams, with all others as rare as the third.
Two disjoint bigrams of the prefix, the rarest such pair by dynamic programming, are its pivots. One edit destroys at most one of two
disjoint bigrams. So of two words one edit apart, take the one whose prefix ends at the less rare bigram (either, if equal): its prefix
holds a pivot of the other word. Beside a surviving pivot the edit lies on one side only, which limits positions: the pivot keeps its
distance to the start, and the text up to it is the same, or it keeps its distance to the end, and the text from it on is the same. Pivots and prefix bigrams meet under a
hash of that text and the length, and what meets is verified with the edit distance. Keys with many pivots are split into slices.

Everything runs on SQL functions. Words are counted before they are shuffled; only distinct words take part in the join.

Defined results: null texts have no words, a null id counts as the empty text in the hash. Without any word the result is empty. Rows that
repeat an id and a text count as often as they occur. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.session import materialize

RUN = "[A-Za-zÀ-ÿ]+"
#: Pivots of one key that meet the prefixes of one slice.
SLICE_PIVOTS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters, A-Z in lower case; the id as text."""
    lowered = F.translate(F.col(text_column), _UPPER, _LOWER)
    return docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"),
    )


def misspelled(rows: DataFrame, one_in: int) -> Column:
    """The run, without one letter in one of ``one_in`` cases of (id, run), chosen by crc32."""
    code = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    place = (code % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return F.when(code % one_in == 0, cut).otherwise(F.col("run"))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n): distinct words of a column ``word`` that are long and frequent enough."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _pivots(prefix: Column) -> Column:
    """Two disjoint bigrams (p, c, g) of an array in order of position whose counts c have the smallest sum.

    State of the walk: the best bigram that doesn't touch the next one for sure, the last one, and the best pair so far.
    Of the earlier bigrams only the last one can overlap with the present one.
    """
    gram = "struct<c:bigint,p:int>"
    start = F.struct(
        F.lit(None).cast(gram).alias("clear"),
        F.lit(None).cast(gram).alias("last"),
        F.lit(None).cast(f"struct<cost:bigint,a:{gram},b:{gram}>").alias("pair"),
    )

    def step(state: Column, x: Column) -> Column:
        here = F.struct(x["c"].alias("c"), x["p"].alias("p"))
        before = F.when(state["last"]["p"] <= x["p"] - 2, F.least(state["clear"], state["last"])).otherwise(state["clear"])
        pair = F.when(before.isNotNull(), F.struct((before["c"] + x["c"]).alias("cost"), before.alias("a"), here.alias("b")))
        return F.struct(
            F.least(state["clear"], state["last"]).alias("clear"), here.alias("last"), F.least(state["pair"], pair).alias("pair")
        )

    return F.aggregate(prefix, start, step, lambda state: F.array(state["pair"]["a"]["p"], state["pair"]["b"]["p"]))


def grams(words: DataFrame) -> DataFrame:
    """(word, n, prefix, pivots, least): positions (from 0) of the prefix and of the pivots, and the bigram that the prefix ends at.

    Words need four letters at least, or they may lack two disjoint bigrams.
    """
    spots = F.sequence(F.lit(0), F.length("word") - 2)
    placed = words.select("word", "n", F.explode(spots).alias("p"))
    placed = placed.withColumn("g", F.substr("word", F.col("p") + 1, F.lit(2)))
    counts = materialize(placed.groupBy("g").agg(F.count("*").alias("c")), "grams")
    listed = placed.join(counts, "g").groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("c", "g", "p"))).alias("all"))
    third = F.struct(F.col("all")[2]["c"].alias("c"), F.col("all")[2]["g"].alias("g"))
    kept = F.filter("all", lambda x: F.struct(x["c"].alias("c"), x["g"].alias("g")) <= F.col("least"))
    by_place = F.array_sort(F.transform("kept", lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c"))))
    found = listed.withColumn("least", third).withColumn("kept", kept)
    return found.select("word", "n", "least", F.transform("kept", lambda x: x["p"]).alias("prefix"), _pivots(by_place).alias("pivots"))


def _sides(place: Column) -> list[Column]:
    """Hashes of what an edit beside the bigram at ``place`` leaves as it is: all up to the bigram's end, or all from its start on."""
    return [F.xxhash64(F.lit("<"), F.substr("word", F.lit(1), place + 2)), F.xxhash64(F.lit(">"), F.substr("word", place + 1))]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words (word, n) that are exactly one edit apart."""
    listed = materialize(grams(words), "prefixes")
    side = lambda name: listed.select("word", "n", "least", F.explode(name).alias("at")).select(
        "word", "n", "least", F.explode(F.array(*_sides(F.col("at")))).alias("part")
    )
    key = lambda length: F.xxhash64("part", length)
    lengths = F.array(*(F.length("word") + d for d in (-1, 0, 1)))
    pivots = side("pivots").withColumn("length", F.explode(lengths)).withColumn("key", key("length"))
    pivots = pivots.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("least").alias("a_least"))
    pivots = materialize(pivots, "pivots")
    prefixes = side("prefix").select(
        key(F.length("word")).alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("least").alias("b_least")
    )
    crowded = materialize(pivots.groupBy("key").count().where(F.col("count") > SLICE_PIVOTS), "crowded")
    slices = F.coalesce(F.ceil(F.col("count") / SLICE_PIVOTS).cast("int"), F.lit(1))
    cut = lambda rows: rows.join(crowded, "key", "left").withColumn("slices", slices).drop("count")
    dealt = cut(pivots).withColumn("slice", F.pmod(F.xxhash64("a"), F.col("slices")).cast("int")).drop("slices")
    met = dealt.join(cut(prefixes).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices"), ["key", "slice"])
    near = met.where((F.col("a_least") <= F.col("b_least")) & (F.levenshtein("a", "b", 1) == 1))
    found = near.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), *(
        F.when((F.col("a") < F.col("b")) == first, F.col("a_n")).otherwise(F.col("b_n")).alias(name)
        for first, name in ((True, "x_n"), (False, "y_n"))
    )).distinct()
    ends = F.array(F.struct("x", "x_n", "y", "y_n"), F.struct(*(F.col(b).alias(a) for a, b in zip(["x", "x_n", "y", "y_n"], ["y", "y_n", "x", "x_n"], strict=True))))
    return found.select(F.inline(ends)).toDF("word", "n", "other", "other_n")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """One row per word of (word, n): form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest), if it occurs ``times`` as often; ``root`` is where forms lead to.
    """
    if times < 2:
        raise ValueError("times must be 2 at least, or forms could lead in circles")
    words = materialize(words, "vocabulary")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    )
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *(F.when(-F.col("best.minus") >= F.col("n") * times, c).alias(a) for c, a in ((F.col("best.form"), "form"), (-F.col("best.minus"), "form_n"))),
    )
    formed = materialize(formed, "forms")
    # Each step along forms multiplies n, so chains are short; doubling halves the rounds again.
    up = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        onward = up.select(F.col("word").alias("to"), F.col("to").alias("further"))
        longer = materialize(up.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), "further"), "roots")
        up = longer.select("word", "to")
        if longer.where("further IS NOT NULL").isEmpty():
            break
    roots = up.select("word", F.col("to").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
