"""Behaviour profiles: named aggregates over a key list, and the texts of each key.

A profile with texts is read off one counted table: how often each key has each value
of each column. Rows are read once and shuffled once, partially counted; a hot key is
spread over its values. Measures fold the counts to one row per key, whatever the key's
size. Texts are there twice: as a long table (key, column, text, n), which models read, and
in ``rows``, the measures with all texts of a key put together in one cell a column. Cells
nobody selects are not built. A measures row has the number of its texts and a digest of
them, which does not depend on their order: keys with equal texts are found by it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlog.constants import (
    A_SERVICE,
    H_SERVICE,
    LOGIN_CODES,
    METHODS,
    STATUS_MARKS,
)
from wardlog.functions.text import has_literal
from wardlog.functions.times import monday_first
from wardlog.operators.ordering import union_all
from wardlog.operators.windows import PLACE, PLACES
from wardlog.session import stored

# What a measure of value counts is told by: the column counted, one of its values, how often.
COLUMN, VALUE, TIMES = "column", "value", "n"


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def status_marks(c: str = "http_retcode", missing: str = "") -> dict[str, Column]:
    """Whether a row's code holds each mark anywhere: 410 counts as ``10``."""
    code = F.col(c).cast("string")
    out = {name: has_literal(code, mark) for name, mark in STATUS_MARKS.items()}
    out["oth_st"] = code == missing
    return out


def method_marks(c: str = "http_method") -> dict[str, Column]:
    out = {name: has_literal(F.col(c), name) for name in METHODS}
    out["OTH"] = F.col(c) == "-"
    return out


def status_ratios(c: str = "http_retcode", missing: str = "") -> dict[str, Column]:
    """Share of rows with each status mark."""
    return {name: share(mark) for name, mark in status_marks(c, missing).items()}


def method_ratios(c: str = "http_method") -> dict[str, Column]:
    return {name: share(mark) for name, mark in method_marks(c).items()}


def port_digits(c: str = "dst_port") -> dict[str, Column]:
    digits = F.length(F.col(c).cast("string"))
    return {f"port_{n}": share(digits == n) for n in range(1, 6)}


def traffic_moments() -> dict[str, Column]:
    out = {}
    for side, name in (("forward", "req"), ("backward", "resp")):
        for unit, short in (("bytes", "b"), ("packets", "p")):
            c = F.col(f"{unit}_{side}")
            out[f"{name}_{short}mean"] = F.avg(c)
            out[f"{name}_{short}var"] = F.var_pop(c)
    return out


def hour_ratios(c: str = "logtime") -> dict[str, Column]:
    return {f"hour_{h}": share(F.hour(c) == h) for h in range(24)}


def weekday_ratios(c: str = "logtime") -> dict[str, Column]:
    return {f"day_{d}": share(monday_first(F.col(c)) == d) for d in range(1, 8)}


def distinct_ports(c: str = "dst_port") -> Column:
    """Exact distinct ports; a port is one of 65,536, so the set stays small."""
    return F.size(F.collect_set(c)).cast("bigint")


def login_outcomes() -> dict[str, Column]:
    code, result = F.col("service_code"), F.col("result")
    return {
        f"{name}_{r}": F.count_if((code == name) & (result == r))
        for name in LOGIN_CODES
        for r in (0, 1)
    }


def service_counts() -> dict[str, Column]:
    code, good = F.col("service_code"), F.col("result") == 0
    groups = {
        "a_service": code == A_SERVICE,
        "h_service": code == H_SERVICE,
        "other_service": ~code.isin(A_SERVICE, H_SERVICE),
    }
    out = {"eflog_total_cnt": F.count(F.lit(1))}
    for name, rows in groups.items():
        out[f"{name}_total"] = F.count_if(rows)
        out[f"{name}_success"] = F.count_if(rows & good)
    out["success"] = F.count_if(good)
    return out


def with_service_ratios(df: DataFrame) -> DataFrame:
    """Shares of successful and failed log-ins per service, over all log-ins."""
    total = F.col("eflog_total_cnt")
    out = {}
    for short in ("a", "h", "other"):
        good = F.col(f"{short}_service_success")
        out[f"{short}_s_ratio"] = good / total
        out[f"{short}_f_ratio"] = (F.col(f"{short}_service_total") - good) / total
    return df.withColumns(out)


def value_spread(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Per key and column: Shannon entropy (base 2) and exact distinct count."""
    folds = {}
    for name in columns:
        folds.update({f"{name}_ent": entropy(name), f"{name}_kinds": kinds(name)})
    return counted(rows, keys, columns).groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def counted(
    rows: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], whole: Mapping[str, Column] | None = None,
    clean: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """(keys, column, value, n): how often each key has each value of each column, null included.

    ``whole`` names further aggregates of a key's rows. They are found in the one row a key
    with a null column and null elsewhere. ``clean`` are functions of a column's values.
    They are applied to counted values, once for all rows of a key with the same value.
    """
    pairs = [F.struct(F.lit(n).alias("c"), c.cast("string").alias("v")) for n, c in columns.items()]
    if whole:
        pairs.append(F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("v")))
    rows = rows.withColumn("_p", F.explode(F.array(*pairs)))
    out = rows.groupBy(*keys, F.col("_p.c").alias(COLUMN), F.col("_p.v").alias(VALUE)).agg(
        F.count(F.lit(1)).alias(TIMES), *[c.alias(n) for n, c in (whole or {}).items()]
    )
    if clean:
        value = F.col(VALUE)
        for name, change in clean.items():
            value = F.when(F.col(COLUMN) == name, change(F.col(VALUE))).otherwise(value)
        # the row with the further aggregates is alone in its group
        folds = [F.max(n).alias(n) for n in whole or {}]
        out = out.withColumn(VALUE, value).groupBy(*keys, COLUMN, VALUE).agg(F.sum(TIMES).alias(TIMES), *folds)
    return out.withColumns({n: F.when(F.col(COLUMN).isNull(), F.col(n)) for n in whole or {}})


def times(name: str, condition: Column | None = None) -> Column:
    """How many rows of a key have a value of a column that meets a condition."""
    of = F.col(COLUMN) == name
    return F.coalesce(F.sum(F.when(of if condition is None else of & condition, F.col(TIMES))), F.lit(0))


def share_of(name: str, condition: Column) -> Column:
    return times(name, condition) / times(name)


def kinds(name: str) -> Column:
    """Exact number of different values."""
    return F.count(F.when((F.col(COLUMN) == name) & F.col(VALUE).isNotNull(), 1))


def entropy(name: str) -> Column:
    """log2(n) - sum(c log2 c) / n over the counts of a column's values: no join to the totals is needed."""
    n = F.when(F.col(COLUMN) == name, F.col(TIMES).cast("double"))
    size = F.sum(n)
    spread = F.log2(size) - F.sum(n * F.log2(n)) / size
    return F.when(F.count(n) > 1, F.greatest(spread, F.lit(0.0))).otherwise(0.0)


def mean_bytes(name: str) -> Column:
    """Mean size of a column's values in bytes."""
    return times_sum(name, F.octet_length(VALUE)) / times(name, F.col(VALUE).isNotNull())


def times_sum(name: str, value: Column) -> Column:
    return F.sum(F.when(F.col(COLUMN) == name, F.col(TIMES) * value))


def status_shares(name: str = "http_retcode", missing: str = "") -> dict[str, Column]:
    return {n: share_of(name, mark) for n, mark in status_marks(VALUE, missing).items()}


def method_shares(name: str = "http_method") -> dict[str, Column]:
    return {n: share_of(name, mark) for n, mark in method_marks(VALUE).items()}


def port_shares(name: str = "dst_port") -> dict[str, Column]:
    return {f"port_{n}": share_of(name, F.length(VALUE) == n) for n in range(1, 6)}


@dataclass(frozen=True)
class Texts:
    """A text column of a profile: each different text once, or every text."""

    column: Column
    distinct: bool = True


def digest(name: str, distinct: bool) -> dict[str, Column]:
    """How many texts a key has in a column and two sums of hashes of them, which stand for the whole."""
    here = (F.col(COLUMN) == name) & F.col(VALUE).isNotNull()
    copies = F.lit(1) if distinct else F.col(TIMES)

    def part(start: int) -> Column:
        number = F.conv(F.substring(F.md5(VALUE), start, 15), 16, 10).cast("decimal(19,0)")
        return F.coalesce(F.sum(F.when(here, number * copies.cast("decimal(18,0)"))), F.lit(0)).cast("string")

    return {
        f"{name}_texts": F.coalesce(F.sum(F.when(here, copies)), F.lit(0)).cast("bigint"),
        f"{name}_digest": F.concat_ws(":", part(1), part(16)),
    }


# Where the hashes of a text's digest begin in it, and the 20 bits of them that are added up by themselves.
HASHES, PARTS = (1, 16), (0, 20, 40)


def with_hashes(counts: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Adds the two hashes of each text, found once for all sums of them."""
    out = counts.withColumn("_md5", F.when(F.col(COLUMN).isin(*texts), F.md5(VALUE)))
    return out.withColumns({f"_hash_{h}": F.conv(F.substring("_md5", h, 15), 16, 10).cast("bigint") for h in HASHES})


def digest_sums(name: str) -> dict[str, Column]:
    """What the digest of all texts is put together from, as whole numbers that can be added up."""

    def part(start: int, bits: int) -> Column:
        number = F.shiftright(f"_hash_{start}", bits).bitwiseAND(F.lit(2**20 - 1))
        return F.coalesce(F.sum(F.when(F.col(COLUMN) == name, number * F.col(TIMES))), F.lit(0))

    sums = {f"{name}_texts": times(name, F.col(VALUE).isNotNull())}
    return sums | {f"{name}_{h}_{bits}": part(h, bits) for h in HASHES for bits in PARTS}


def digest_of(name: str) -> dict[str, Column]:
    """Number and digest of the texts from added sums."""
    part = lambda h, bits: F.col(f"{name}_{h}_{bits}").cast("decimal(20,0)") * F.lit(2**bits).cast("decimal(14,0)")
    parts = [sum((part(h, bits) for bits in PARTS[1:]), part(h, 0)).cast("string") for h in HASHES]
    return {f"{name}_texts": F.col(f"{name}_texts"), f"{name}_digest": F.concat_ws(":", *parts)}


def joined(name: str, distinct: bool) -> Column:
    """All texts of a key in a column, sorted, blanks between; every copy unless different ones count once.

    What is gathered are different texts with their counts; copies are made in the cell.
    """
    here = (F.col(COLUMN) == name) & F.col(VALUE).isNotNull()
    copies = F.lit(1) if distinct else F.col(TIMES).cast("int")
    found = F.sort_array(F.collect_list(F.when(here, F.struct(F.col(VALUE).alias("v"), copies.alias("n")))))
    return cell(found)


def cell(found: Column) -> Column:
    """Texts ``v`` of a sorted list, each ``n`` times, blanks between."""
    copied = F.transform(found, lambda e: F.concat(F.repeat(F.concat(e["v"], F.lit(" ")), e["n"].cast("int") - 1), e["v"]))
    return F.concat_ws(" ", copied)


@dataclass(frozen=True)
class Profiles:
    """Profile rows, one per key, and the texts behind them as a long table.

    ``rows`` are the measures and a cell with all texts of the key for each of ``columns``;
    ``measures`` are the rows without the cells. ``texts`` has the keys, ``column``, ``text``
    and ``n``: 1 where different texts count once, else how often the key has the text.
    """

    keys: tuple[str, ...]
    rows: DataFrame
    texts: DataFrame
    columns: tuple[str, ...]

    @property
    def measures(self) -> DataFrame:
        return self.rows.drop(*self.columns)

    def stored(self, name: str = "profiles") -> Profiles:
        """Measures and texts written once, for callers that read both or read one several times; cells are left out."""
        return Profiles(self.keys, stored(self.measures, f"{name}-measures"), stored(self.texts, f"{name}-texts"), self.columns)

    def with_measures(self, change) -> Profiles:
        """The profiles whose rows ``change`` keeps and adds to; texts of other keys go when they are read."""
        rows = change(self.rows)
        texts = self.texts.join(rows.select(*self.keys).distinct(), list(self.keys), "left_semi")
        return Profiles(self.keys, rows, texts, self.columns)

    def renamed(self, names: Mapping[str, str]) -> Profiles:
        """Keys and text columns under other names."""
        digests = {f"{a}_{end}": f"{b}_{end}" for a, b in names.items() for end in ("texts", "digest")}
        column = F.col(COLUMN)
        for a, b in names.items():
            if a in self.columns:
                column = F.when(F.col(COLUMN) == a, b).otherwise(column)
        texts = self.texts.withColumn(COLUMN, column).withColumnsRenamed({a: b for a, b in names.items() if a in self.keys})
        new = lambda found: tuple(names.get(c, c) for c in found)
        return Profiles(new(self.keys), self.rows.withColumnsRenamed({**names, **digests}), texts, new(self.columns))

    def with_key(self, name: str, value: Column) -> Profiles:
        """A further key with the same value for all rows."""
        return Profiles((name, *self.keys), self.rows.withColumn(name, value), self.texts.withColumn(name, value), self.columns)


def united(profiles: Sequence[Profiles]) -> Profiles:
    """Profiles of the same keys and columns in one."""
    first = profiles[0]
    tables = [union_all([getattr(p, name) for p in profiles]) for name in ("rows", "texts")]
    return Profiles(first.keys, *tables, first.columns)


def profile(
    rows: DataFrame,
    keys: Sequence[str],
    texts: Mapping[str, Texts],
    folds: Mapping[str, Column] | None = None,
    values: Mapping[str, Column] | None = None,
    whole: Mapping[str, Column] | None = None,
    keep: Column | None = None,
) -> Profiles:
    """Profiles of the keys of ``rows``.

    ``values`` are counted like the texts, for ``folds`` to measure; ``whole`` are plain
    aggregates of a key's rows. ``keep`` is a condition on measures. Rows have the order
    whole, folds, numbers and digests of texts, texts.
    """
    counts = counted(rows, keys, {**(values or {}), **{n: t.column for n, t in texts.items()}}, whole)
    out = from_counts(counts, keys, {n: t.distinct for n, t in texts.items()}, folds or {}, list(whole or {}))
    return out if keep is None else out.with_measures(lambda m: m.where(keep))


def from_counts(
    counts: DataFrame, keys: Sequence[str], texts: Mapping[str, bool], folds: Mapping[str, Column], whole: Sequence[str] = ()
) -> Profiles:
    """Profiles read off counted values; ``texts`` tells which text columns count each text once."""
    aggregates = {n: F.max(n) for n in whole} | dict(folds)
    for n, distinct in texts.items():
        aggregates |= digest(n, distinct)
    aggregates |= {n: joined(n, distinct) for n, distinct in texts.items()}
    rows = counts.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    once = [n for n, distinct in texts.items() if distinct]
    copies = F.when(F.col(COLUMN).isin(*once), F.lit(1)).otherwise(F.col(TIMES)) if once else F.col(TIMES)
    found = counts.where(F.col(COLUMN).isin(*texts) & F.col(VALUE).isNotNull())
    found = found.select(*keys, COLUMN, F.col(VALUE).alias("text"), copies.cast("bigint").alias(TIMES))
    return Profiles(tuple(keys), rows, found, tuple(texts))


# Windows that share a list of texts.
BLOCK = 16


def running_sums(counts: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], whole: Sequence[str] = ()) -> DataFrame:
    """``sums`` of each key's counts up to each place, and ``whole`` of the place itself."""
    aggregates = {n: F.max(n) for n in whole} | dict(sums)
    out = counts.groupBy(*keys, PLACE).agg(*[c.alias(n) for n, c in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumns({n: F.sum(n).over(before) for n in sums})


def block_of(place: str) -> Column:
    return F.expr(f"{place} div {BLOCK}")


def text_blocks(counts: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Sorted lists of the texts of each key's places, ``BLOCK`` places a list and a list a column.

    ``counts`` are by key and place. A list's entry is a text, how often the places from
    ``a`` to ``b`` have it or places before them. There is an entry where a text's count
    changes, and each list begins with the counts it finds.
    """
    found = counts.where(F.col(COLUMN).isin(*texts) & F.col(VALUE).isNotNull() & (F.col(PLACE) < F.col(PLACES)))
    same = Window.partitionBy(*keys, COLUMN, VALUE).orderBy(PLACE)
    n = F.sum(TIMES).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.coalesce(F.lead(PLACE).over(same), F.col(PLACES)) - 1
    spans = found.select(*keys, COLUMN, VALUE, F.col(PLACE).alias("a"), last.alias("b"), n.alias(TIMES))
    spans = spans.withColumn("block", F.explode(F.sequence(block_of("a"), block_of("b"))))
    entry = F.struct(F.col(VALUE).alias("v"), "a", "b", F.col(TIMES).alias("n"))
    lists = [F.sort_array(F.collect_list(F.when(F.col(COLUMN) == c, entry))).alias(c) for c in texts]
    return spans.groupBy(*keys, "block").agg(*lists)


def with_texts(windows: DataFrame, blocks: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Windows with the list of the texts (v, n) at their place for each column; one without texts has none."""
    out = windows.join(blocks, [*keys, "block"], "left")
    here = lambda e: (e["a"] <= F.col(PLACE)) & (e["b"] >= F.col(PLACE))
    return out.withColumns({c: F.filter(c, here) for c in texts})


def listed(texts: Sequence[str]) -> Column:
    """The texts of all columns in one list of (column, text, n)."""

    def named(name: str) -> Column:
        entry = lambda e: F.struct(F.lit(name).alias(COLUMN), e["v"].alias("text"), e["n"].alias(TIMES))
        return F.transform(name, entry)

    return F.flatten(F.array_compact(F.array(*[named(c) for c in texts]))).cast(f"array<struct<{COLUMN}:string,text:string,{TIMES}:bigint>>")


def added_counts(counts: DataFrame, whole: Mapping[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """Counted values of several batches added up; ``whole`` tells how its aggregates are merged."""
    whole = whole or {}
    keys = [c for c in counts.columns if c not in (TIMES, *whole)]
    added = counts.groupBy(*keys).agg(F.sum(TIMES).alias(TIMES), *[merge(n).alias(n) for n, merge in whole.items()])
    return added.select(*counts.columns)


def cleaned_texts(columns: Mapping[str, str], clean, distinct: bool) -> dict[str, Texts]:
    """Output name -> the cleaned texts of a column."""
    return {n: Texts(clean(F.col(c)), distinct) for n, c in columns.items()}
