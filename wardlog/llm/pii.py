"""Personal data in texts by weak supervision, in DataFrame expressions only.

Patterns give the base spans (email, ip, card, phone). Wider patterns give
further candidates: addresses written with words for the signs, and numbers in
the shape of a phone or card that the base patterns miss. Labelers vote on each
candidate: the pattern's own check, gazetteers of words and prefixes, and the text
around it. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is, and a logistic span classifier is trained on those
likelihoods. A base span is always kept; a further candidate is added if the
classifier finds it likelier than not and it touches no span kept before.

Only texts with a digit, an @ or a written-out sign are searched by pattern. Spans
are found within their row, so no text is shuffled; the fit sees vote counts alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.words import spare
from wardlog.session import stored

KINDS = ("email", "ip", "card", "phone")
# What a base span looks like. Repetitions are possessive where what
# follows cannot begin inside them, so no text makes the matcher go back and forth.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Shapes of further candidates.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,4}+",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Gazetteers.
NEAR_WORDS = {
    "email": ["mail", "e-mail", "email", "contact", "write", "reply"],
    "card": ["card", "visa", "mastercard", "credit", "debit", "payment"],
    "phone": ["phone", "tel", "call", "mobile", "fax", "cell"],
    "ip": ["ip", "host", "server", "address"],
}
ENDINGS = r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
PREFIXES = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
LABELERS = ("checked", "listed", "near", "edges", "grouped")
AROUND = 40


def found_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, left to right, in code points.

    The pieces between matches come from a split by the same pattern, so a start is
    the length of all pieces and matches before it.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(
        values, F.slice(pieces, 1, F.size(values)), lambda v, p: F.struct(F.length(p).alias("gap"), v.alias("value"))
    )
    empty = F.array().cast("array<struct<start: int, end: int, value: string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        one = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda s: s["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the card checksum."""
    backwards = F.split(F.reverse(digits_of(value)), "")
    doubled = F.transform(
        backwards,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The check that a span of a kind must pass."""
    n = F.length(digits_of(value))
    octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", value.rlike(rf"^{octet}(\.{octet}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & luhn(value))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def candidates(text: Column) -> Column:
    """Array of (kind, base, start, end, votes ...) of base spans and further candidates.

    Votes are 1 for, -1 against, 0 none. Null where the text is null or cannot have any.
    """
    has = {
        "email": F.instr(text, "@") > 0,
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"(?:[0-9][\x20-]?){13}"),
        "phone": F.instr(text, "+") > 0,
    }
    wide = {
        "email": text.rlike(r"[\[(]at[\])]"),
        "card": has["card"],
        "phone": text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]{3}"),
    }
    none = F.array().cast("array<struct<start: int, end: int, value: string>>")

    def tagged(kind, pattern, when, base):
        def around(s):
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                F.substring(text, F.greatest(s["start"] - AROUND + 1, F.lit(1)), F.least(s["start"], F.lit(AROUND))).alias("left"),
                F.substring(text, s["end"] + 1, F.lit(AROUND)).alias("right"),
            )

        return F.transform(F.when(when[kind], found_spans(text, pattern)).otherwise(none), around)

    spans = F.concat(*(tagged(k, p, has, True) for k, p in BASE.items()), *(tagged(k, p, wide, False) for k, p in WIDER.items()))
    spans = F.filter(spans, lambda s: ~s["base"] | passes(s["kind"], s["value"]))
    spans = F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "base", "start", "end")), *votes(s)))
    return F.when(text.rlike("[0-9@]|[\\[(]at[\\])]"), spans)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def votes(s: Column) -> list[Column]:
    """One vote of each labeler on a candidate, named as in ``LABELERS``."""
    kind, value, left, right = s["kind"], s["value"], s["left"], s["right"]
    near = F.lit(False)
    for name, words in NEAR_WORDS.items():
        seen = F.concat_ws(" ", left, right).rlike(r"(?i)(?<![a-z])(" + "|".join(words) + ")(?![a-z])")
        near = F.when(kind == name, seen).otherwise(near)
    prefixed = digits_of(value).rlike(PREFIXES)
    listed_yes = F.when(kind == "email", value.rlike(ENDINGS)).when(kind == "card", prefixed).otherwise(False)
    joined = left.rlike("[0-9A-Za-z][.-]?$") | right.rlike("^[.-]?[0-9A-Za-z]") | left.rlike(r"[$=#]\x20?$")
    one_digit = value.rlike(r"^([0-9])(?:[\x20().-]?\1)*$")
    no = F.lit(False)
    return [
        vote(passes(kind, value), ~passes(kind, value)).alias("checked"),
        vote(listed_yes, (kind == "card") & ~prefixed).alias("listed"),
        vote(near, no).alias("near"),
        vote(no, joined).alias("edges"),
        vote(value.rlike(r"[\x20()@.-]"), one_digit).alias("grouped"),
    ]


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50):
    """Prior and vote likelihoods of true and false spans, by expectation-maximisation.

    ``patterns`` has each vote pattern once with its count: 3 ** labelers rows at most.
    Labelers are taken as independent given the truth. Every labeler starts as better
    than chance, so class 1 stays the true one.
    """
    width = len(LABELERS)
    prior = 0.7
    likely = [[{1: 0.5, 0: 0.4, -1: 0.1} for _ in range(width)], [{1: 0.1, 0: 0.4, -1: 0.5} for _ in range(width)]]
    chance = {}
    for _ in range(rounds):
        for pattern, _n in patterns:
            yes = math.log(prior) + sum(math.log(likely[0][j][v]) for j, v in enumerate(pattern))
            no = math.log(1 - prior) + sum(math.log(likely[1][j][v]) for j, v in enumerate(pattern))
            chance[pattern] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
        total = sum(n for _, n in patterns)
        sure = sum(chance[p] * n for p, n in patterns)
        prior = min(0.99, max(0.01, (sure + 1) / (total + 2)))
        for side, weight in ((0, lambda p: chance[p]), (1, lambda p: 1 - chance[p])):
            mass = sum(weight(p) * n for p, n in patterns)
            start = {1: (0.5, 0.1), 0: (0.4, 0.4), -1: (0.1, 0.5)}
            for j in range(width):
                # the starting values count as ten votes
                likely[side][j] = {
                    v: (sum(weight(p) * n for p, n in patterns if p[j] == v) + 10 * start[v][side]) / (mass + 10) for v in (1, 0, -1)
                }
    return prior, likely, chance


def trained(rows: list[tuple[tuple[float, ...], float, int]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights (the last is the constant) from (features, likelihood, count) rows."""
    weights = [0.0] * (len(rows[0][0]) + 1) if rows else []
    total = sum(n for _, _, n in rows)
    for _ in range(steps):
        slope = [0.0] * len(weights)
        for x, y, n in rows:
            z = weights[-1] + sum(w * v for w, v in zip(weights, x))
            off = n * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for j, v in enumerate((*x, 1.0)):
                slope[j] += off * v
        weights = [w + rate * (s / total - 1e-4 * w) for w, s in zip(weights, slope)]
    return weights


def fit(found: DataFrame) -> list[float]:
    """Weights of the span classifier from a table with a column ``_found`` of candidates.

    The driver sees each combination of kind and votes once: 4 * 3 ** labelers rows at most.
    """
    each = found.select(F.explode("_found").alias("s")).select(F.col("s.kind").alias("kind"), *(F.col(f"s.{v}") for v in LABELERS))
    counted = sorted((tuple(r[v] for v in LABELERS), r["kind"], r["count"]) for r in each.groupBy("kind", *LABELERS).count().collect())
    patterns: dict = {}
    for vote_pattern, _, n in counted:
        patterns[vote_pattern] = patterns.get(vote_pattern, 0) + n
    _, _, chance = reliabilities(sorted(patterns.items()))
    lessons = [((*map(float, p), *(float(kind == k) for k in KINDS[:-1])), chance[p], n) for p, kind, n in counted]
    return trained(lessons)


def chosen(found: Column, weights: list[float]) -> Column:
    """The spans that stay: (place, start, end, kind, base), sorted by kind as in ``KINDS``, then start.

    All base spans, and each further candidate the classifier finds likely that passes
    its kind's check and overlaps none taken before it. Null where ``found`` is null.
    """

    def likely(s):
        score = F.lit(weights[-1] if weights else -1.0)
        for w, v in zip(weights, LABELERS):
            score = score + F.lit(w) * s[v]
        for w, k in zip(weights[len(LABELERS) :], KINDS[:-1]):
            score = score + F.when(s["kind"] == k, F.lit(w)).otherwise(0.0)
        return score >= 0

    def place(s):
        return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("place")

    def span(s, order):
        return F.struct(*(place(s) if c == "place" else s[c].alias(c) for c in order))

    by_kind, by_start = ("place", "start", "end", "kind", "base"), ("start", "end", "place", "kind", "base")
    base = F.transform(F.filter(found, lambda s: s["base"]), lambda s: span(s, by_kind))
    wider = F.sort_array(F.transform(F.filter(found, lambda s: ~s["base"] & (s["checked"] >= 0) & likely(s)), lambda s: span(s, by_start)))

    def add(out, s):
        hit = F.exists(out, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
        one = F.struct(*(s[c].alias(c) for c in by_kind))
        return F.when(hit, out).otherwise(F.concat(out, F.array(one)))

    return F.sort_array(F.aggregate(wider, base, add))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined; empty text for none."""
    texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(texts, ","), F.lit(""))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row for each row of ``docs``.

    Counts and digest are those of the base spans, ``spans`` lists all. A null or
    empty text has none. Null ids and repeated rows have their rows like others.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), candidates(F.col(text_col).cast("string")).alias("_found"))
    found = stored(found, "candidates")
    found = found.withColumn("_spans", chosen(F.col("_found"), fit(found)))
    base = F.filter("_spans", lambda s: s["base"])
    count = lambda k: F.coalesce(F.size(F.filter(base, lambda s: s["kind"] == k)), F.lit(0)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; columns stay as they were.

    Spans that overlap are replaced as one, named by the first. ``size_col``, if there
    is one, is set to the new length where a text changed.
    """
    text = F.col(text_col)
    weights = fit(stored(docs.select(candidates(text).alias("_found")).where("size(_found) > 0"), "candidates"))
    spans, new = spare(docs, "spans"), spare(docs, "new_text")
    found = docs.withColumn(spans, chosen(candidates(text), weights))
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        more = F.when(s["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    changed = F.aggregate(
        by_start, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    )
    found = found.withColumn(new, F.when(F.size(spans) > 0, changed))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.coalesce(new, c).alias(c))
        elif c == size_col:
            kind = docs.schema[c].dataType
            out.append(F.coalesce(F.length(new).cast(kind), F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return found.select(*out)
