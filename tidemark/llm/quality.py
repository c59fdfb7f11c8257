"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Four statistics of a text (mean word length, symbols a word, share of repeated lines, share of repeated words) are
transformed by logarithms and put on an integer grid. For each language and source the minimum covariance determinant
is sought from several starts (medians and quartile ranges; all texts; all texts, the farther the lighter): in each
concentration step the three quarters of the texts with the smallest Mahalanobis distances give the next mean and
covariance, until the determinant no longer falls. The start that ends with the smallest determinant gives the
estimate, and texts far beyond it are rejected.

Short texts measure their statistics poorly, so a text's deviations count with a weight that grows with its words.
Sums over grid values are integers, so estimates don't depend on partitioning. The steps run over distinct grid
cells with counts, aggregated by (group, start, distance bin) before any shuffle; copies weigh nothing. Estimates are
joined under several salts each, so that no task gets a language or a large source whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
DIMS = 4
#: Grid steps a natural-log unit, and the largest grid value.
GRID, TOP = 200, 1600
#: Least standard deviations, in grid steps: ordinary prose has hardly any symbols or repetitions, and their first few are no defect. The
#: largest values that pass the base rules (480 and 277 for repeated lines and words) lie beyond the cutoff by themselves.
FLOORS = (16.0, 25.0, 40.0, 28.0)
#: Texts that an estimate needs; smaller groups use their language's, small languages that of all texts.
LEAST_TEXTS = 60
CORE = 0.75
#: For a core of 3/4 in 4 dimensions: 0.75 / P(chi2 with 6 degrees < 5.385), makes the covariance consistent.
CONSISTENCY = 1.488
#: A step counts as falling if the logarithm of the determinant falls by so much.
FALL = 1e-3
#: Squared distance beyond which a text is rejected: twice the one-in-a-million point of chi2 with 4 degrees, since tails of real texts are heavier.
CUTOFF = 66.8
#: Bins of distances for each unit of their logarithm: the core is three quarters of the texts but for one bin.
BINS = 64
SALTS = 16


def _windows(words: Column, n: Column) -> Column:
    return F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice(words, i, 8)))).otherwise(F.array().cast("array<bigint>"))


def _with_covered(df: DataFrame) -> DataFrame:
    """Adds ``__covered``, words in windows of ``__h`` that occur twice or more (windows are known by 64-bit hashes
    within one text). Each array is a column of its own: inside another's lambda it would be made anew for each element."""
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__o", F.when(twice, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    o = F.col("__o")
    again = lambda e, j: F.when((F.get(o, j - 1)["h"] == e["h"]) | (F.get(o, j + 1)["h"] == e["h"]), e["i"])
    df = df.withColumn("__at", F.sort_array(F.array_compact(F.transform(o, again))))
    at = F.col("__at")
    steps = F.transform(at, lambda p, j: F.coalesce(F.least(p - F.get(at, j - 1), F.lit(8)), F.lit(8)))
    return df.withColumn("__covered", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("__w", F.array_remove(F.split(text, BLANK), ""))
    df = df.withColumn("__l", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("__h", _windows(F.col("__w"), F.size("__w")))
    return _with_covered(df).select(
        *docs.columns,
        "n_words",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__covered").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _grid(share: Column) -> Column:
    return F.least(F.round(GRID * F.log1p(share)), F.lit(TOP)).cast("long")


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        _grid(F.col("word_chars") / n).alias("x0"),
        _grid(10 * F.col("n_symbols") / n).alias("x1"),
        _grid(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        _grid(10 * F.col("n_repeat_words") / n).alias("x3"),
        # 0 to 16: the square of a text's weight
        F.round(16 * n / (n + 40)).cast("long").alias("wt"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0..x3 by mean m0.. and Cholesky factor l00, l10, ..."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return F.col("wt") / 16 * sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(df: DataFrame, cov) -> DataFrame:
    """Adds the Cholesky factor of ``cov(i, j)`` with the floors' squares on the diagonal, which makes it definite, and
    ``logdet``, the logarithm of the determinant."""
    for i in range(DIMS):
        for j in range(i + 1):
            v = cov(i, j) + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00")))


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
PARAMS = ["__group", "start", "n", "logdet", *(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in PAIRS)]


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``few``, of which each row stands under all salts: a key with very many rows has many tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(SALTS)).cast("int")
    under = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(under, [*keys, "__salt"], how).drop("__salt")


def _medians(cells: DataFrame) -> DataFrame:
    """The first start: medians and quartile ranges, from one histogram of grid values for each group and dimension."""
    one = cells.select("__group", "c", F.posexplode(F.array(*(f"x{i}" for i in range(DIMS)))).alias("d", "x"))
    hist = one.groupBy("__group", "d", "x").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("__group", "d")
    cum = hist.select("__group", "d", "x", F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"), F.sum("c").over(w).alias("n"))
    quartile = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("n") * q, F.col("x")))
    q = cum.groupBy("__group", "d").agg(F.max("n").alias("n"), *(quartile(k).cast("double").alias(f"q{k}") for k in (1, 2, 3)))
    wide = q.groupBy("__group").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("d") == i, F.col("q2"))).alias(f"m{i}") for i in range(DIMS)), *(F.max(F.when(F.col("d") == i, (F.col("q3") - F.col("q1")) / 1.349)).alias(f"s{i}") for i in range(DIMS)))
    wide = wide.withColumn("start", F.lit(0))
    return _factor(wide, lambda i, j: F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).select(*PARAMS)


def _moments(weight: Column) -> list[Column]:
    x = lambda i: F.col(f"x{i}")
    return [F.sum(weight).alias("w"), *(F.sum(weight * x(i)).alias(f"w{i}") for i in range(DIMS)), *(F.sum(weight * x(i) * x(j)).alias(f"w{i}{j}") for i, j in PAIRS)]


def _estimates(sums: DataFrame, scale: float) -> DataFrame:
    """Mean and covariance from moments; ``c``: the texts that they are of."""
    sums = sums.select("*", *((F.col(f"w{i}") / F.col("w")).alias(f"m{i}") for i in range(DIMS)))
    cov = lambda i, j: scale * (F.col(f"w{i}{j}") - F.col("w") * F.col(f"m{i}") * F.col(f"m{j}")) / F.col("c")
    return _factor(sums, cov).select(*PARAMS)


def _starts(cells: DataFrame, medians: DataFrame) -> DataFrame:
    """All starts. Beside the medians: the moments of all texts, and those with weights that fall with the distance."""
    c, wt = F.col("c"), F.col("c") * F.col("wt")
    near = _salted(cells, medians.drop("start", "logdet"), ["__group"]).withColumn("light", F.ceil(64.0 / F.greatest(_distance(), F.lit(4.0))))
    light = F.col("light")  # 1 to 16, whole numbers: sums don't depend on their order
    every = near.groupBy("__group").agg(F.max("n").alias("n"), (16 * F.sum(c)).alias("c"), *_moments(wt)).withColumn("start", F.lit(1))
    closer = near.groupBy("__group").agg(F.max("n").alias("n"), (16 * F.sum(c * light)).alias("c"), *_moments(wt * light)).withColumn("start", F.lit(2))
    return medians.unionByName(_estimates(every, 1.0)).unionByName(_estimates(closer, 1.0))


def _step(cells: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step from each start."""
    bins = (
        _salted(cells, params.drop("logdet"), ["__group"])
        .withColumn("bin", F.floor(BINS * F.log1p(_distance())))
        .groupBy("__group", "start", "bin")
        .agg(F.max("n").alias("n"), F.sum("c").alias("c"), *_moments(F.col("c") * F.col("wt")))
    )
    before = F.sum("c").over(Window.partitionBy("__group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    core = bins.withColumn("__before", before).where(F.col("__before") < CORE * F.col("n"))
    sums = core.groupBy("__group", "start").agg(F.max("n").alias("n"), (16 * F.sum("c")).alias("c"), *(F.sum(k).alias(k) for k in ("w", *(f"w{i}" for i in range(DIMS)), *(f"w{i}{j}" for i, j in PAIRS))))
    return _estimates(sums, CONSISTENCY)


def minimum_determinants(cells: DataFrame) -> DataFrame:
    """``PARAMS`` of each group of cells ``(__group, x0..x3, wt, c)`` with at least ``LEAST_TEXTS`` texts: the estimate
    with the smallest determinant that any start leads to.

    Every start takes a step, as starts need not be cores; after that an estimate is replaced only by one with a
    smaller determinant, and a start whose determinant doesn't fall is done. Cores are finitely many, so all end.
    """
    medians = written(_medians(cells).where(F.col("n") >= LEAST_TEXTS), "quality-medians")
    falling = written(_step(cells, written(_starts(cells, medians), "quality-starts")), "quality-step")
    done = []
    while not falling.isEmpty():
        now = F.col("o.logdet") - F.col("s.logdet") > FALL
        both = falling.alias("o").join(_step(cells, falling).alias("s"), ["__group", "start"])
        stepped = written(both.select("__group", "start", now.alias("falls"), *(F.when(now, F.col(f"s.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in PARAMS[2:])), "quality-step")
        done.append(stepped.where(~F.col("falls")).select(*PARAMS))
        falling = stepped.where("falls").select(*PARAMS)
    if not done:
        return medians
    every = functools.reduce(DataFrame.unionByName, done)
    best = F.min_by(F.struct(*PARAMS), F.struct("logdet", "start")).alias("best")
    return every.groupBy("__group").agg(best).select("best.*")


def with_verdicts(docs: DataFrame, *, keep: list[str], lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (apart from those named below) with the statistics, ``base_failed``, ``distance`` (squared; null without an estimate) and ``kept``.

    Null texts have no words and fail; null languages and sources are groups of their own. Groups with fewer than
    ``LEAST_TEXTS`` texts that pass the base rules take their language's estimate or that of all texts; where these
    are as few, only the base rules reject. Repeated rows get equal verdicts. The texts are read once and never shuffled, unless
    the estimates outgrow the session's broadcast threshold.
    """
    out = _judged(docs, keep, lang_col, source_col, text_col)
    return out.select(*[F.col(f"k_{k}").alias(k) for k in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


#: Up to so many distinct rejected rows' keys are sent to every task (some 60 MB there); more are joined.
SENT_KEYS = 1_000_000
KEY = ["__k1", "__k2"]


def good_documents(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``with_verdicts`` keeps, with all their columns, whatever these are called.

    Nulls, empty and very long texts, small groups and repeated rows are judged as there; an empty table stays empty.

    A verdict depends on language, source and text alone, so rejected rows are known by 128-bit hashes of these; the
    texts are neither written nor, while there are few such keys, shuffled.
    """
    own = [f"k_{c}" for c in docs.columns]
    parts = [x for c in (lang_col, source_col, text_col) for x in (F.col(f"k_{c}").isNull(), F.col(f"k_{c}"))]
    keyed = docs.toDF(*own).withColumns({"__k1": F.xxhash64(*parts), "__k2": F.xxhash64(F.lit(1), *parts)})
    judged = _judged(keyed, KEY, f"k_{lang_col}", f"k_{source_col}", f"k_{text_col}")
    bad = written(judged.where(~F.col("kept")).select(*[F.col(f"k_{k}").alias(k) for k in KEY]).distinct(), "quality-rejected")
    if bad.count() <= SENT_KEYS:
        bad = F.broadcast(bad)
    return keyed.join(bad, KEY, "left_anti").select(*own).toDF(*docs.columns)


def _judged(docs: DataFrame, keep: list[str], lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """The columns ``keep``, their names begun with k_, and the results."""
    name = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    stats = docs.select(*[F.col(k).alias(f"k_{k}") for k in keep], name(lang_col).alias("__lang"), name(source_col).alias("__source"), F.col(text_col).alias("__text"))
    stats = with_statistics(stats, "__text").drop("__text")
    stats = written(stats.select("*", base_failed().alias("base_failed"), *_vector()), "quality-rows")
    cells = stats.where(~F.col("base_failed")).groupBy("__lang", "__source", *(f"x{i}" for i in range(DIMS)), "wt").agg(F.count(F.lit(1)).alias("c"))
    cells = written(cells, "quality-cells")
    of_source, of_lang, of_all = F.concat_ws("\x1f", "__lang", "__source"), F.col("__lang"), F.lit("*")
    sizes = cells.groupBy("__lang", "__source").agg(F.sum("c").alias("n"))
    langs = sizes.groupBy("__lang").agg(F.sum("n").alias("n_lang"))
    group = F.when(F.col("n") >= LEAST_TEXTS, of_source).when(F.col("n_lang") >= LEAST_TEXTS, of_lang).otherwise(of_all)
    groups = written(sizes.join(langs, "__lang").select("__lang", "__source", group.alias("__group")), "quality-groups")
    cells = cells.withColumn("__group", F.explode(F.array(of_source, of_lang, of_all))).drop("__lang", "__source")
    cells = cells.join(groups.select("__group").distinct(), "__group", "left_semi").groupBy("__group", *(f"x{i}" for i in range(DIMS)), "wt").agg(F.sum("c").alias("c"))
    params = minimum_determinants(written(cells, "quality-grouped"))
    by_source = written(groups.join(params, "__group").drop("__group", "n", "start", "logdet"), "quality-estimates")
    out = _salted(stats, by_source, ["__lang", "__source"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept)


def op6_covariance_outliers(docs: DataFrame) -> DataFrame:
    """Digest per document; see ``with_verdicts``."""
    return with_verdicts(docs, keep=["doc_id"]).drop("distance")
