"""Quality rules: word statistics of whole texts and robust multivariate outliers among them.

Each (language, source) gets a minimum-covariance-determinant estimate of its transformed statistics: concentration
steps from deterministic starts, each step one distributed pass that keeps the h rows of least Mahalanobis distance
(found through a histogram of log distances, so no group is gathered or sorted in one place) and sums their moments.
Groups with too few rows use their language's estimate, else that of all rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_broadcast, mapped, stored, text_or_empty

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!\"'()+,-./:;=?@[\\]^_`{}~"
#: Share of a group's rows that the determinant is minimised over, concentration steps, and rows a group needs.
SHARE, STEPS, LEAST_ROWS = 0.7, 4, 150
#: A row is an outlier beyond this quantile of the chi-square distribution.
QUANTILE = 1 - 1e-12
#: Added to every variance, in squared units of the transformed statistics: no statistic counts as constant.
RIDGE = 0.02
DIMENSION = 7
#: Histogram cells per unit of the natural log of a squared distance.
CELLS = 32


def chunk_statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Base statistics of each text of a chunk; words are runs of anything but ASCII white space; null has none."""
    out = {name: np.zeros(len(texts), dtype=np.int64) for name in STATISTICS}
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        counts[i] = len(words)
        flat.extend([numbers.setdefault(w, len(numbers)) for w in words])
        out["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
        for name, chars in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_digits", DIGITS), ("n_marks", MARKS)):
            out[name][i] = len(raw) - len(raw.translate(None, chars))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_words"] = counts
    ids = np.array(flat, dtype=np.int64)
    if len(ids) >= 3:
        doc = np.repeat(np.arange(len(texts)), counts)
        size = len(numbers)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        _, pair = np.unique((doc[at] * size + ids[at]) * size + ids[at + 1], return_inverse=True)
        _, window, times = np.unique(pair * size + ids[at + 2], return_inverse=True, return_counts=True)
        again = at[times[window] > 1]
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[again + k] = True
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(texts))
    return out


def statistics(docs: DataFrame, keys: list[str], with_text: bool = False) -> DataFrame:
    """The key columns and STATISTICS of each row's whole text. `keys` are (name, type) as 'name type'."""
    names = [k.split()[0] for k in keys] + ["text"] * with_text
    schema = ", ".join([*keys, *["text string"] * with_text, *(f"{s} long" for s in STATISTICS)])

    def work(part: pa.RecordBatch) -> dict:
        found = chunk_statistics(part["text"].to_pylist())
        return {n: part[n] for n in names} | {k: pa.array(v) for k, v in found.items()}

    return mapped(docs.select(*[n for n in names if n != "text"], text_or_empty().alias("text")), work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """Statistics on scales where clean texts of any length are spread alike."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    share = lambda c, of, least: F.log(F.lit(least) + F.col(c) / of)
    return [F.log(words) / 2, 3 * F.log(chars / words), share("n_symbols", chars, 0.02), share("n_dup_lines", lines, 0.6), share("n_repeat_words", words, 0.4), share("n_upper", chars, 0.05), share("n_marks", chars, 0.03)]


def chi_square(p: float, k: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _distance(x: str, mean: str, precision: str, d: int = DIMENSION) -> Column:
    at = lambda c, i: F.col(c)[i]
    diff = [at(x, i) - at(mean, i) for i in range(d)]
    terms = [at(precision, i * d + j) * diff[i] * diff[j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(1e-9))


def _cell(distance: Column) -> Column:
    return F.floor(F.log(distance) * CELLS).cast("int")


def _moments(d: int = DIMENSION) -> list[Column]:
    return [F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(d) if j >= i]).alias("ss")]


ESTIMATE = "level int, g1 string, g2 string, begin int, mean array<double>, precision array<double>, det double"


def _estimates(moments: DataFrame, d: int = DIMENSION) -> DataFrame:
    """Mean, inverse covariance and log determinant from each group's moments; rounded, so that the order of sums leaves no trace."""

    def solve(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                mean = np.array(r.s) / r.n
                cov = np.zeros((d, d))
                cov[np.triu_indices(d)] = np.array(r.ss) / r.n
                cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
                cov = (cov + cov.T) / 2 + RIDGE * np.eye(d)
                out.append((r.level, r.g1, r.g2, r.begin, np.round(mean, 8).tolist(), np.round(np.linalg.inv(cov), 8).ravel().tolist(), round(float(np.linalg.slogdet(cov)[1]), 8)))
            yield pd.DataFrame(out, columns=["level", "g1", "g2", "begin", "mean", "precision", "det"])

    return moments.mapInPandas(solve, ESTIMATE)


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS, d: int = DIMENSION) -> DataFrame:
    """One estimate for each group at each of three levels: 0 all rows, 1 language, 2 language and source.

    rows: g1, g2 (never null), x. Each level's rows are counted apart. Returns ESTIMATE columns and scale (to the
    chi-square's median), n.
    """
    key, cellkey = ["level", "g1", "g2"], ["level", "g1", "g2", "begin"]
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("g1"), F.lit("").alias("g2")), F.struct(F.lit(1).alias("level"), F.col("g1").alias("g1"), F.lit("").alias("g2")), F.struct(F.lit(2).alias("level"), F.col("g1").alias("g1"), F.col("g2").alias("g2")))
    at = rows.select(F.explode(levels).alias("k"), "x").select("k.*", "x")
    middle = at.groupBy(*key).agg(F.count("*").alias("rows"), *[F.percentile_approx(F.col("x")[i], 0.5, 2000).alias(f"m{i}") for i in range(d)])
    middle = stored(middle.where(f"level < 2 or rows >= {LEAST_ROWS}").select(*key, "rows", F.array(*[F.col(f"m{i}") for i in range(d)]).alias("mean")), "mcd-middle")
    groups = checked_broadcast(middle)
    spread = at.join(groups, key).groupBy(*key).agg(F.first("mean").alias("mean"), *[F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 2000).alias(f"d{i}") for i in range(d)])
    diagonal = F.array(*[(1 / (RIDGE + (1.4826 * F.col(f"d{i}")) ** 2) if i == j else F.lit(0.0)) for i in range(d) for j in range(d)])
    flat = F.array(*[F.lit(1.0 if i == j else 0.0) for i in range(d) for j in range(d)])
    now = stored(spread.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("begin"), diagonal.alias("precision")), F.struct(F.lit(1).alias("begin"), flat.alias("precision")))).alias("b"), "mean").select(*key, "b.begin", "mean", "b.precision", F.lit(0.0).alias("det")), "mcd-start")

    def cells(estimate: DataFrame) -> DataFrame:
        return at.join(checked_broadcast(estimate.drop("det")), key).withColumn("cell", _cell(_distance("x", "mean", "precision")))

    def nth(measured: DataFrame, part: float) -> DataFrame:
        """The cell that the row at this share of the distances falls in."""
        counts = measured.groupBy(*cellkey, "cell").count()
        by = Window.partitionBy(*cellkey)
        counts = counts.withColumn("upto", F.sum("count").over(by.orderBy("cell"))).withColumn("all", F.sum("count").over(by))
        return counts.where(F.col("upto") >= F.ceil(F.col("all") * part)).groupBy(*cellkey).agg(F.min("cell").alias("last"))

    for _ in range(steps):
        measured = cells(now)
        limit = stored(nth(measured, share), "mcd-limit")
        kept = measured.join(checked_broadcast(limit), cellkey).where("cell <= last")
        now = stored(_estimates(kept.groupBy(*cellkey).agg(*_moments())), "mcd-step")
    best = now.groupBy(*key).agg(F.min_by(F.struct("begin", "mean", "precision", "det"), F.struct("det", "begin")).alias("b")).select(*key, "b.*")
    best = stored(best, "mcd-best")
    half = nth(cells(best), 0.5).select(*key, (F.exp((F.col("last") + 0.5) / CELLS) / F.lit(chi_square(0.5, d))).alias("scale"))
    return stored(best.join(half, key).join(middle.select(*key, "rows"), key), "mcd")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds base_failed, the group keys (never null) and the vector."""
    name = lambda c: F.concat(F.lit("="), F.coalesce(c, F.lit("\0")))
    return rows.withColumn("base_failed", base_failed()).withColumn("g1", name("lang")).withColumn("g2", name("source")).withColumn("x", F.transform(F.array(*transformed()), lambda v: F.round(v, 8)))


def models(found: DataFrame) -> DataFrame:
    """Estimates from all stored rows of statistics (with lang and source) that pass the base rules."""
    return estimates(_placed(found).where(~F.col("base_failed")).select("g1", "g2", "x"))


def verdicts(rows: DataFrame, fitted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Adds base_failed, distance and kept to rows of statistics with lang and source."""
    rows = _placed(rows)
    side = fitted.select("level", "g1", "g2", "rows", F.struct("mean", "precision", "scale").alias("e"))
    own = checked_broadcast(side.where("level = 2").select("g1", "g2", F.col("e").alias("e2")))
    language = checked_broadcast(side.where(f"level = 1 and rows >= {LEAST_ROWS}").select("g1", F.col("e").alias("e1")))
    overall = F.broadcast(side.where("level = 0").select(F.col("e").alias("e0")))  # one row at most
    rows = rows.join(own, ["g1", "g2"], "left").join(language, "g1", "left").join(overall, F.lit(True), "left")
    rows = rows.withColumn("e", F.coalesce("e2", "e1", "e0")).withColumn("mean", F.col("e.mean")).withColumn("precision", F.col("e.precision"))
    rows = rows.withColumn("distance", _distance("x", "mean", "precision") / F.greatest(F.col("e.scale"), F.lit(1.0)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= F.lit(chi_square(quantile, DIMENSION)))
    return rows.withColumn("kept", kept).drop("g1", "g2", "e", "e0", "e1", "e2", "mean", "precision", "x")


KEYS = ("doc_id long", "lang string", "source string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(k.split()[0]).cast(k.split()[1]).alias(k.split()[0]) for k in KEYS], "text")


def quality(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document (null text: no words, so it fails the base rules). Repeated rows get a
    row each; an empty table gives none."""
    found = stored(statistics(_keyed(docs), list(KEYS)), "statistics")
    return verdicts(found, models(found))


def kept(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) that the rules keep. The statistics are computed again for the
    verdict, which is cheaper than moving the texts to join them."""
    fitted = models(stored(statistics(_keyed(docs), list(KEYS)), "statistics"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"), "text")
    rows = statistics(docs, [*KEYS, "n_chars long"], with_text=True)
    return verdicts(rows, fitted).where("kept").select("doc_id", "text", "lang", "source", "n_chars")
