"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects a document whose value exceeds a cutoff. Cutoffs are chosen per stratum on labelled holdouts:
walking from the mildest cutoff to the strictest, one is certified while the exact binomial test rejects "the rule
loses more than ALPHA of this stratum's good documents" at level DELTA / (strata x rules): Bonferroni over strata and
rules, fixed sequence within a rule (so cutoffs need no correction). With confidence 1 - DELTA no rule loses more than
ALPHA of any stratum's good documents, so all of them together no more than ALPHA times their number. Equal texts with
equal labels are one trial. Of the certified cutoffs, the one with the best
net gain (bad documents caught less good ones lost) is used, the mildest of equals. Rules of a stratum without
enough good documents stay off: there, nothing can be guaranteed, and documents are kept.

Nulls: a null text has no words; a null stratum is the stratum ''. Labels that are null, or whose document is
missing, don't count. Documents of fewer than MIN_WORDS words, or with more than
MAX_REPEAT of their words in repeated windows, fail by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, text_or_empty

SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 0.3
#: MAX_STRATA: strata with cutoffs that are broadcast; more are joined by a shuffle.
ALPHA, DELTA, MAX_STRATA = 0.005, 0.05, 256

#: (rule, numerator, denominator, cutoffs from the mildest to the strictest). Fixed values.
RULES: list[tuple[str, str, str, list[float]]] = [
    ("symbols", "n_symbols", "n_words", [4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1]),
    ("dup_lines", "n_dup_lines", "n_lines", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2]),
    ("repeats", "n_repeat_words", "n_words", [0.28, 0.25, 0.2, 0.15, 0.1, 0.05]),
    ("capitals", "n_upper", "word_chars", [0.9, 0.7, 0.5, 0.3, 0.2]),
    ("long_words", "word_chars", "n_words", [30.0, 20.0, 15.0, 12.0, 10.0]),
    ("short_words", "n_words", "word_chars", [1.0, 0.6, 0.5, 0.4, 0.33]),
]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with __th (its hash), __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __n_lines, __n_upper."""
    f = lambda n: F.col(f"__{n}")
    keep = [c for c in docs.columns if c != text_col]
    counted = [f("th"), f("word_chars"), f("n_symbols"), f("n_dup_lines"), f("n_lines"), f("n_upper")]
    t, lines = f("t"), F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = docs.withColumn("__t", text_or_empty(text_col)).select(
        *keep,
        F.transform(F.array_remove(F.split("__t", f"[{SPACE}]+"), ""), lambda w: F.xxhash64(w)).alias("__words"),  # the text and its words end here
        F.xxhash64("__t").alias("__th"),
        F.length(F.translate("__t", SPACE_CHARS, "")).cast("long").alias("__word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("__n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("__n_dup_lines"),
        F.size(lines).cast("long").alias("__n_lines"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("__n_upper"),
    )
    n_words = F.size("__words").cast("long").alias("__n_words")
    gram = lambda i: F.xxhash64(*[F.get(f("words"), i + k) for k in range(WINDOW)])
    grams = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), gram)).otherwise(F.array().cast("array<bigint>"))
    d = d.select(*keep, *counted, n_words, grams.alias("__grams"))
    # only texts with a repeated window lay them out with their places
    placed = F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.when(F.size(F.array_distinct("__grams")) < F.size("__grams"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    d = d.select(*keep, *counted, f("n_words"), pairs.alias("__pairs"))
    same = lambda x, k, o: F.get(f("pairs"), k + o)["h"] == x["h"]
    twice = F.filter("__pairs", lambda x, k: F.coalesce(same(x, k, -1), F.lit(False)) | F.coalesce(same(x, k, 1), F.lit(False)))
    d = d.select(*keep, *counted, f("n_words"), F.sort_array(F.transform(twice, lambda x: x["i"])).alias("__at"))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).cast("int").alias("n"), (i + WINDOW).cast("int").alias("end")), lambda a: a["n"])
    return d.select(*keep, *counted, f("n_words"), covered.cast("long").alias("__n_repeat_words"))


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (F.col("__n_repeat_words") * 100 > F.col("__n_words") * int(MAX_REPEAT * 100))


def _value(rule: tuple) -> Column:
    return F.coalesce(F.try_divide(F.col(f"__{rule[1]}").cast("double"), F.col(f"__{rule[2]}").cast("double")), F.lit(0.0))


def lower_tail(x: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), where x is below n p; 1 elsewhere. Summed term by term from logarithms."""
    import math

    first = n * math.log1p(-p)
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("t"), a["s"].alias("s"))
    add = lambda a: F.struct(a["t"].alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), x), F.struct(first.alias("t"), F.exp(first).alias("s")), lambda a, i: add(step(a, i)), lambda a: a["s"])
    return F.when(x >= n * p, F.lit(1.0)).when(x == 0, F.exp(first)).otherwise(total)


def calibrate(feats: DataFrame, labels: DataFrame, id_col: str, stratum: str, stash: Stash) -> DataFrame:
    """One row per stratum with a certified cutoff: the stratum, and a cutoff (or null: off) per rule."""
    marks = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("__id"), (F.col("quality") > 0).alias("__good"))
    known = feats.where(~base_failed()).join(marks, F.col(id_col) == F.col("__id")).withColumn("__stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    known = known.dropDuplicates(["__stratum", "__th", "__good"])  # copies aren't independent trials
    hits = [F.sum(((_value(r) > c) & (F.col("__good") == good)).cast("long")).alias(f"{r[0]}_{k}_{int(good)}") for r in RULES for k, c in enumerate(r[3]) for good in (True, False)]
    by = known.groupBy("__stratum").agg(F.sum(F.col("__good").cast("long")).alias("n"), *hits)
    by = stash.put(by, "strata")
    m = max(1, by.count())
    cells = F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(k).alias("k"), F.lit(c).alias("cutoff"), F.col(f"{r[0]}_{k}_1").alias("lost"), F.col(f"{r[0]}_{k}_0").alias("caught")) for r in RULES for k, c in enumerate(r[3])])
    strata = by.select("__stratum", "n", F.explode(cells).alias("x")).select("__stratum", "n", "x.*")
    level = DELTA / (m * len(RULES))
    tested = strata.withColumn("ok", lower_tail(F.col("lost"), F.col("n"), ALPHA) <= level)
    from pyspark.sql import Window

    walk = Window.partitionBy("__stratum", "rule").orderBy("k")
    certified = tested.withColumn("so_far", F.min(F.col("ok").cast("int")).over(walk)).where("so_far = 1 and caught > lost")
    best = certified.groupBy("__stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - F.col("lost"), -F.col("k"))).alias("cutoff"))
    return best.groupBy("__stratum").pivot("rule", [r[0] for r in RULES]).agg(F.first("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", stash: Stash | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id and the columns keep, the features (named without their underscores), base_failed, kept; a row per document."""
    stash = stash or Stash(docs.sparkSession, "quality")
    feats = stash.put(features(docs.select(id_col, text_col, stratum, *keep), text_col), "features")
    cutoffs = stash.put(calibrate(feats, labels, id_col, stratum, stash), "cutoffs")
    if cutoffs.limit(MAX_STRATA + 1).count() <= MAX_STRATA:
        cutoffs = F.broadcast(cutoffs)
    rows = feats.join(cutoffs, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__stratum"), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_value(r) > F.col(r[0]), F.lit(False))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(id_col, *keep, *[F.col(f"__{n}").alias(n) for n in names], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
