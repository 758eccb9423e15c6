"""Mixing documents to target domain weights, with soft domain membership.

A naive Bayes classifier, learned from a labelled table, gives each document a
likelihood of every domain. Least squares then fits a rate for every document, so
that the expected tokens of each domain, the sum of rate times tokens times
likelihood, match the target; its dual has one unknown a domain and is solved by
Newton steps until the targets are met. All of it is DataFrame expressions
and aggregates; the driver sees sums per domain and a vocabulary of ``TERMS`` terms.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import own, spare
from wardlog.session import stored

MAX_ROWS, TERMS, LEAST_DOCS, LIFT = 8_000, 96, 3, 4.0
# A fit ends at CLOSE of all tokens; STEPS aggregates are far more than it takes and only end one that rounding keeps from it.
STEPS, CLOSE = 1_000, 1e-9
NONE = "\n"  # stands for texts without any marker
BREAKS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct lower-case words, runs of punctuation, and a term for the share of distinct words.

    The latter two start with a line break, which no word holds.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.split(F.lower(text), BREAKS)
    single = F.array_distinct(found)
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[!-/:-@\[-`{-~]{2,}"), F.lit(0)))
    share = F.floor(10 * F.size(single) / F.size(found)).cast("string")
    return F.concat(single, F.transform(runs, lambda r: F.concat(F.lit("\n"), F.substring(r, 1, 2))), F.array(F.concat(F.lit("\n"), share)))


def token_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("bigint")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table: toxic, low or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int, id_col: str, text_col: str):
    """Log prior, and the log likelihood of each marker term, per domain.

    Learned from at most ``max_rows`` labelled rows, those with the smallest id hash (a
    documented bound). Markers are terms at least ``LIFT`` times as frequent in one
    domain as in the others; of these the ones that tell most. A missing term says
    nothing, so short texts are not taken for another domain, but having none at all
    counts like a term. Labels of other domains, null labels and null ids are not used.
    """
    rows = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_rows)
    rows = rows.select(F.col("doc_id").alias("_id"), "domain")
    # max_rows rows of an id and a short text
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(rows), F.col("_doc") == F.col("_id"))
    texts = texts.select("domain", terms(F.col("_text")).alias("terms"))
    texts = stored(texts, "lessons")
    size = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total = sum(size.values())
    if not total:
        return [0.0] * len(domains), {}
    seen = texts.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(
        *(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{j}") for j, d in enumerate(domains))
    )
    n = [F.col(f"n{j}") for j in range(len(domains))]
    have = sum(n[1:], n[0])
    told = F.lit(0.0)
    for j, d in enumerate(domains):
        mine, others = size.get(d, 0), total - size.get(d, 0)
        lift = ((n[j] + 0.5) / (mine + 1)) / ((have - n[j] + 0.5) / (others + 1))
        told = F.greatest(told, F.when((lift >= LIFT) & (n[j] >= LEAST_DOCS), n[j] * F.log(lift)).otherwise(0.0))
    best = seen.withColumn("told", told).where("told > 0").orderBy(F.desc("told"), "term").limit(TERMS).collect()
    start = [math.log((size.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    weights = {
        r["term"]: [math.log((r[f"n{j}"] + 0.5) / (size.get(d, 0) + 1)) for j, d in enumerate(domains)] for r in best
    }
    if weights:
        found = F.array_intersect("terms", F.array(*map(F.lit, weights)))
        bare = {r["domain"]: r["count"] for r in texts.where(F.size(found) == 0).groupBy("domain").count().collect()}
        weights[NONE] = [math.log((bare.get(d, 0) + 0.5) / (size.get(d, 0) + 1)) for d in domains]
    return start, weights


def _adding(table: Column):
    return lambda total, term: total + F.element_at(table, term)


def with_memberships(
    rows: DataFrame, text_col: str, domains: list[str], start: list[float], weights: Mapping[str, list[float]]
) -> DataFrame:
    """Adds the likelihood of each domain given the text, as p_<domain>; they add up to 1.

    Done in steps, so that a text is cut into terms once however many domains there are.
    """
    markers = F.array(*map(F.lit, weights)) if weights else F.array().cast("array<string>")
    rows = rows.withColumn("_here", F.array_intersect(terms(F.col(text_col)), markers))
    rows = rows.withColumn("_here", F.when(F.size("_here") == 0, F.array(F.lit(NONE))).otherwise(F.col("_here")))
    for j, d in enumerate(domains):
        score = F.lit(start[j])
        if weights:
            table = F.create_map(*(c for t, w in weights.items() for c in (F.lit(t), F.lit(w[j]))))
            score = F.aggregate("_here", score, _adding(table))
        rows = rows.withColumn(f"_s_{d}", score)
    scores = [F.col(f"_s_{d}") for d in domains]
    top = F.greatest(*scores, F.lit(float("-inf")))
    rows = rows.withColumns({f"_e_{d}": F.exp(s - top) for d, s in zip(domains, scores)})
    total = sum((F.col(f"_e_{d}") for d in domains), F.lit(0.0))
    return rows.withColumns({f"p_{d}": F.col(f"_e_{d}") / total for d in domains})


def fitted_rates(
    rows: DataFrame, weights: Mapping[str, float], anchor: str | None, lower: float, upper: float | None
) -> DataFrame:
    """Adds ``rate`` to rows with n_tokens and one p_<domain> column for each weight.

    Of all rates that reach the targets these are the nearest to 1: a rate is 1 less one
    product of its likelihoods with a number a domain, put between ``lower`` and
    ``upper``, and at 1 at least for documents whose likeliest domain is ``anchor``. The
    numbers maximise a concave function whose gradient is what is off the targets; its
    value, gradient and curvature are one aggregate over all rows, for Newton steps with
    a proximal term that is made ever smaller. Where no rates reach the targets it ends
    when the squared distance, over the domains' present tokens, is proved to be within
    a millionth of the least possible. What is left is logged then.
    """
    domains = list(weights)
    share = [F.col("n_tokens") * F.col(f"p_{d}") for d in domains]
    first = rows.agg(*(F.sum(s).alias(d) for s, d in zip(share, domains))).first()
    have = [float(first[d] or 0) for d in domains]
    scale = sum(weights[d] for d in domains)
    total = sum(have)
    if anchor is not None:
        total = have[domains.index(anchor)] * scale / weights[anchor]
    goal = [total * weights[d] / scale for d in domains]
    least = F.lit(lower)
    if anchor is not None:
        likeliest = F.col(f"p_{anchor}") >= F.greatest(*(F.col(f"p_{d}") for d in domains), F.lit(0.0))
        least = F.when(likeliest, max(lower, 1.0)).otherwise(lower)
    if upper is not None:
        least = F.least(F.lit(upper), least)
    n, p = F.col("n_tokens"), [F.col(f"p_{d}") for d in domains]

    def product(numbers) -> Column:
        return sum((c * F.lit(float(x)) for c, x in zip(p, numbers)), F.lit(0.0))

    def rate_for(summed) -> Column:
        moved = F.greatest(least, F.lit(1.0) - product(summed))
        return moved if upper is None else F.least(F.lit(upper), moved)

    def sums(*columns: Column) -> np.ndarray:
        return np.array([float(x or 0) for x in rows.agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns))).first()])

    size, goal, have = len(domains), np.array(goal), np.array(have)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def look(summed):
        """Off the targets, curvature and value at some numbers."""
        rate, moved = rate_for(summed), F.lit(1.0) - product(summed)
        free = moved > least if upper is None else (moved > least) & (moved < upper)
        value = n * ((rate - 1) * (rate - 1) / 2 + rate * product(summed))
        found = sums(*(rate * c for c in share), value, *(F.when(free, share[i] * p[j]) for i, j in pairs))
        curve = np.zeros((size, size))
        for (i, j), x in zip(pairs, found[size + 1 :]):
            curve[i, j] = curve[j, i] = x
        return found[:size] - goal, curve, found[size] - goal @ summed

    def proved_nearest(summed, off) -> bool:
        """Whether no rates within the limits are clearly nearer: bounds the gain by that of the best ones for this slope."""
        slope, rate = product(np.divide(off, have, out=np.zeros(size), where=have > 0)), rate_for(summed)
        highest = float("inf") if upper is None else upper
        none = 1e-9 * product(np.divide(np.abs(off), have, out=np.zeros(size), where=have > 0))  # a slope of rounding only
        (gap,) = sums(n * F.when(slope > none, slope * (rate - least)).when(slope < -none, slope * (rate - F.lit(highest))).otherwise(0.0))
        distance = (np.divide(off**2, have, out=np.zeros(size), where=have > 0)).sum() / 2
        return gap <= 1e-6 * distance

    # a domain without tokens cannot be reached by any rate
    live, close = have > 0, CLOSE * max(total, 1)
    at, looks = np.zeros(size), 1
    off, curve, value = look(at)
    nearest = False
    for damp in (1e-3, 1e-5, 1e-7, 1e-9, 1e-9, 1e-9):
        if not live.any() or np.abs(off[live]).max() <= close or nearest:
            break
        base = at
        while looks < STEPS:
            slope = np.where(live, off - damp * have * (at - base), 0.0)
            if np.abs(slope).max() <= close:
                break
            step = np.zeros(size)
            step[live] = np.linalg.solve((curve + damp * np.diag(have))[np.ix_(live, live)], slope[live])
            worth = value - damp * (have * (at - base) ** 2).sum() / 2
            length = 1.0
            while True:
                there = at + length * step
                new = look(there)
                looks += 1
                new_slope = np.where(live, new[0] - damp * have * (there - base), 0.0)
                gain = new[2] - damp * (have * (there - base) ** 2).sum() / 2 - worth
                if gain >= 1e-4 * length * (slope @ step) or np.abs(new_slope).max() <= np.abs(slope).max() / 2 or length < 1e-6 or looks >= STEPS:
                    break
                length /= 2
            at, (off, curve, value) = there, new
            if length < 1e-6:
                break  # rounding keeps it from more
        if np.abs(off[live]).max() > close:
            nearest = proved_nearest(at, off)
            looks += 1
    if np.abs(off).max() > close:
        left = ", ".join(f"{d} {x:+.6g} of {g:.6g}" for d, x, g in zip(domains, off, goal))
        logging.getLogger(__name__).warning("tokens off the targets, %s: %s", "no rates are nearer" if nearest else f"after {looks} aggregates", left)
    return rows.withColumn("rate", rate_for(at))


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    anchor: str | None = None,
    lower: float = 0.0,
    upper: float | None = None,
    max_rows: int = MAX_ROWS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate, copies): one row for each row of ``docs``.

    ``weights`` are the domains' target shares of all tokens, which are as many as now, or
    with ``anchor`` so many that this domain keeps its tokens; documents that most likely
    belong to it are then all kept. ``copies`` is the rate
    rounded up or down by a hash of the row, so that its mean is the rate: the sampling
    this operator is for. An empty or null text has no tokens and the likelihoods of
    its (missing) terms. Rows with a null id and repeated rows are treated like others;
    rows equal in id and tokens get equal copies. Without labels all domains are as
    likely. Where no rates reach the targets, the nearest ones within the limits are
    returned. An empty table gives no rows. Other columns are not read.
    """
    domains = list(weights)
    start, learned = learn(docs, labelled, domains, max_rows, id_col, text_col)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), token_count(text).alias("n_tokens"), text.alias("_text"))
    rows = with_memberships(rows, "_text", domains, start, learned).select("doc_id", "n_tokens", *(f"p_{d}" for d in domains))
    rows = fitted_rates(stored(rows, "memberships"), weights, anchor, lower, upper)
    chance = F.xxhash64(F.lit(seed), "doc_id", "n_tokens") / F.lit(2.0**64) + 0.5
    return rows.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def resampled(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns stay.

    Rows of a null id stay once.
    """
    id_col = options.get("id_col", "doc_id")
    drawn = mixed(docs, labelled, weights, **options)
    # rows that share an id are drawn alike, by their largest count
    other = drawn.groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies <> 1 and doc_id is not null")
    one, many, time = (spare(docs, name) for name in ("one", "many", "time"))
    rows = docs.join(other.select(F.col("doc_id").alias(one), F.col("copies").alias(many)), F.col(id_col) == F.col(one), "left")
    times = F.coalesce(many, F.lit(1))
    rows = rows.where(times > 0).withColumn(time, F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*own(docs))
