"""KPI measures: aggregates, arithmetic between them, and one-pass evaluation.

A ``Measure`` is built from Spark SQL expressions (text or ``Column``) and combined with
``+ - * /``. ``evaluate`` computes any number of measures over one base in one aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.ranks import grouped_quantiles
from metricloom.functions.text import finite
from metricloom.session import together

ADDITIVE, SEMI_ADDITIVE, NON_ADDITIVE = "additive", "semi_additive", "non_additive"
_RANK = {ADDITIVE: 0, SEMI_ADDITIVE: 1, NON_ADDITIVE: 2}


class SpecError(ValueError):
    """A measure names a column the tables do not have, or names it ambiguously."""


def as_column(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


@dataclass(frozen=True)
class Aggregate:
    """One aggregate over rows: what, of which expression, over which rows."""

    fn: str
    of: str | Column | None = None
    where: str | Column | None = None

    @property
    def text(self) -> str:
        inner = "*" if self.of is None else str(self.of)
        return f"{self.fn}({inner}{'' if self.where is None else f' WHERE {self.where}'})"

    def rows(self) -> Column:
        """The aggregated expression, null on rows the condition leaves out."""
        of = F.lit(1) if self.of is None else as_column(self.of)
        return of if self.where is None else F.when(as_column(self.where), of)

    def column(self) -> Column:
        return {
            "SUM": F.sum,
            "AVG": F.avg,
            "COUNT": F.count,
            "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
            "MIN": F.min,
            "MAX": F.max,
            "STDDEV": F.stddev_samp,
        }[self.fn](self.rows())

    @property
    def additivity(self) -> str:
        if self.fn in ("SUM", "COUNT"):
            return ADDITIVE
        return SEMI_ADDITIVE if "DISTINCT" in self.fn else NON_ADDITIVE


class Measure:
    """An aggregate, a number, or arithmetic between measures."""

    def __init__(self, op: str, *parts):
        self.op, self.parts = op, parts

    # Aggregates -----------------------------------------------------------
    @staticmethod
    def _of(fn, of, where):
        return Measure("agg", Aggregate(fn, of, where))

    @staticmethod
    def sum(of, where=None):
        return Measure._of("SUM", of, where)

    @staticmethod
    def avg(of, where=None):
        return Measure._of("AVG", of, where)

    @staticmethod
    def count(of=None, where=None):
        return Measure._of("COUNT", of, where)

    @staticmethod
    def count_distinct(of, where=None, approximate=False):
        return Measure._of("APPROX_COUNT_DISTINCT" if approximate else "COUNT_DISTINCT", of, where)

    @staticmethod
    def min(of, where=None):
        return Measure._of("MIN", of, where)

    @staticmethod
    def max(of, where=None):
        return Measure._of("MAX", of, where)

    @staticmethod
    def median(of, where=None):
        return Measure._of("MEDIAN", of, where)

    @staticmethod
    def stddev(of, where=None):
        return Measure._of("STDDEV", of, where)

    # Arithmetic -----------------------------------------------------------
    @staticmethod
    def _lift(x):
        return x if isinstance(x, Measure) else Measure("num", x)

    def __add__(self, other):
        return Measure("+", self, Measure._lift(other))

    def __radd__(self, other):
        return Measure._lift(other) + self

    def __sub__(self, other):
        return Measure("-", self, Measure._lift(other))

    def __rsub__(self, other):
        return Measure._lift(other) - self

    def __mul__(self, other):
        return Measure("*", self, Measure._lift(other))

    def __rmul__(self, other):
        return Measure._lift(other) * self

    def __truediv__(self, other):
        return Measure("/", self, Measure._lift(other))

    def __rtruediv__(self, other):
        return Measure._lift(other) / self

    def __neg__(self):
        return Measure("neg", self)

    # What it is -----------------------------------------------------------
    def aggregates(self) -> list[Aggregate]:
        if self.op == "agg":
            return [self.parts[0]]
        return [a for p in self.parts if isinstance(p, Measure) for a in p.aggregates()]

    @property
    def text(self) -> str:
        if self.op == "agg":
            return self.parts[0].text
        if self.op == "num":
            return str(self.parts[0])
        if self.op == "neg":
            return f"-{self.parts[0].text}"
        return f"({self.parts[0].text} {self.op} {self.parts[1].text})"

    @property
    def additivity(self) -> str:
        """Whether segment values sum to the total, overlap, or cannot be shared out."""
        if self.op == "agg":
            return self.parts[0].additivity
        if self.op == "num":
            return ADDITIVE
        if self.op in "*/":
            return NON_ADDITIVE
        return max((p.additivity for p in self.parts), key=_RANK.get)

    def column(self, of=None) -> Column:
        """The measure as a column; ``of`` maps an aggregate to a column already computed."""
        of = of or Aggregate.column
        if self.op == "agg":
            return of(self.parts[0])
        if self.op == "num":
            return F.lit(self.parts[0])
        left = self.parts[0].column(of).cast("double")
        if self.op == "neg":
            return -left
        right = self.parts[1].column(of).cast("double")
        if self.op == "/":
            return F.try_divide(left, right)
        return {"+": left.__add__, "-": left.__sub__, "*": left.__mul__}[self.op](right)


def check(df: DataFrame, measures: Mapping[str, Measure]) -> None:
    """Let the analyzer resolve every measure; a bad or ambiguous name is a SpecError."""
    for name, measure in measures.items():
        if not measure.aggregates():
            raise SpecError(f"{name}: a KPI needs at least one aggregate")
        try:
            df.select(*[a.rows().alias(f"c{i}") for i, a in enumerate(measure.aggregates())]).schema
        except AnalysisException as error:
            raise SpecError(f"{name}: {error.getMessage() if hasattr(error, 'getMessage') else error}") from error


#: Conditions one mask of a distinct count holds; an expression with more takes several masks.
MASK_BITS = 62
#: Masks for the groups of one grouping; a grouping that needs more is counted by itself.
GROUP_WORDS = 8


def _given_out(
    df: DataFrame, by: Mapping[str, Column], wanted: Mapping[str, Aggregate], numbered: Callable[[DataFrame], DataFrame] = lambda picked: picked,
) -> tuple[list[list[tuple[str, Aggregate]]], list, DataFrame]:
    """Aggregates by expression, the types of these, and rows ``by + (_of, _t0, ..., _mask)``, one per row and expression.

    ``numbered`` may change the columns of ``by`` before rows are given out.
    """
    sources: dict[str, list[tuple[str, Aggregate]]] = {}
    for name, leaf in wanted.items():
        sources.setdefault(str(leaf.of), []).append((name, leaf))
    lots = [own[i:i + MASK_BITS] for own in sources.values() for i in range(0, len(own), MASK_BITS)]
    columns, masks = [], []
    for j, lot in enumerate(lots):
        bits = [F.lit(1 << i).cast("bigint") if leaf.where is None else F.when(as_column(leaf.where), F.lit(1 << i).cast("bigint")).otherwise(0)
                for i, (_, leaf) in enumerate(lot)]
        columns.append((F.lit(1) if lot[0][1].of is None else as_column(lot[0][1].of)).alias(f"_v{j}"))
        masks.append(F.when(columns[j].isNotNull(), reduce(Column.__add__, bits)).otherwise(0).alias(f"_m{j}"))
    picked = numbered(df.select(*[c.alias(k) for k, c in by.items()], *columns, *masks))
    # expressions of one type share a column
    types = list(dict.fromkeys(picked.schema[f"_v{j}"].dataType for j in range(len(lots))))
    given = [
        F.struct(F.lit(j).alias("_of"), F.col(f"_m{j}").alias("_mask"),
                 *[(F.col(f"_v{j}") if t == picked.schema[f"_v{j}"].dataType else F.lit(None).cast(t)).alias(f"_t{k}") for k, t in enumerate(types)])
        for j in range(len(lots))
    ]
    left = [c for c in picked.columns if c not in {f"_{x}{j}" for x in "vm" for j in range(len(lots))}]
    return lots, types, picked.select(*left, F.inline(F.array(*given))).where("_mask <> 0")


def distinct_counts(df: DataFrame, by: Mapping[str, Column], wanted: Mapping[str, Aggregate]) -> DataFrame:
    """Distinct values of expressions under conditions, per group: a column per name.

    First every (group, expression, value) gets a mask that tells which conditions it was met
    under, then set bits are counted per group. A row is given out once per expression, however
    many conditions count it, and a group of any size is spread by its values.
    """
    lots, types, rows = _given_out(df, by, wanted)
    values = rows.groupBy(*by, "_of", *[f"_t{k}" for k in range(len(types))]).agg(F.bit_or("_mask").alias("_mask"))
    counts = [
        F.count_if((F.col("_of") == j) & (F.col("_mask").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0)).alias(name)
        for j, lot in enumerate(lots) for i, (name, _) in enumerate(lot)
    ]
    return values.groupBy(*by).agg(*counts) if by else values.agg(*counts)


def distinct_counts_by(df: DataFrame, groupings: Sequence[Mapping[str, Column]], wanted: Mapping[str, Aggregate]) -> list[DataFrame]:
    """``distinct_counts`` of several groupings of no key or one, in one shuffle of a row per distinct value.

    Groups are numbered, and each value gets masks that tell the groups and conditions it was met
    in. A grouping of more groups than GROUP_WORDS masks can hold is counted by itself.
    """
    keys = [next(iter(by.items()), None) for by in groupings]
    width = min(MASK_BITS, max(Counter(str(leaf.of) for leaf in wanted.values()).values()))
    a_word = MASK_BITS // width
    few = lambda name, c: df.select(c.alias(name)).where(F.col(name).isNotNull()).distinct().limit(GROUP_WORDS * a_word + 1)
    found = together(*[lambda k=k: few(*k).toArrow() if k else None for k in keys])
    shared = [i for i, t in enumerate(found) if t is None or t.num_rows <= GROUP_WORDS * a_word]
    spark, numbers = df.sparkSession, {}
    for i in shared:
        if keys[i]:
            named = df.select(keys[i][1].alias(f"_k{i}")).schema.add(f"_g{i}", T.IntegerType())
            numbers[i] = spark.createDataFrame(pa.table({f"_k{i}": found[i].column(0), f"_g{i}": pa.array(range(found[i].num_rows), pa.int32())}), named)

    def numbered(picked: DataFrame) -> DataFrame:
        for i, table in numbers.items():
            picked = picked.join(F.broadcast(table), f"_k{i}", "left").drop(f"_k{i}")
        return picked

    lots, types, rows = _given_out(df, {f"_k{i}": keys[i][1] for i in numbers}, wanted, numbered)
    places = [(i, w) for i in shared for w in range(1 if found[i] is None else -(-found[i].num_rows // a_word))]
    words = [F.expr(f"case when _g{i} div {a_word} = {w} then shiftleft(_mask, _g{i} % {a_word} * {width}) else 0L end" if keys[i] else "_mask") for i, w in places]
    values = rows.groupBy("_of", *[f"_t{k}" for k in range(len(types))]).agg(*[F.bit_or(c).alias(f"_w{j}") for j, c in enumerate(words)])

    of_all, word_all = len(lots), len(places)  # all that the tasks need

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((of_all, word_all, MASK_BITS), dtype=np.int64)
        for batch in batches:
            of = batch.column(0).to_numpy()
            for p in range(word_all):
                word = batch.column(p + 1).to_numpy()
                for j in range(of_all):
                    own = word[(of == j) & (word != 0)]
                    any_of = int(np.bitwise_or.reduce(own)) if len(own) else 0
                    for bit in (b for b in range(MASK_BITS) if any_of >> b & 1):
                        sums[j, p, bit] += np.count_nonzero(own & (1 << bit))
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in at], pa.array(sums[at])], names=["j", "p", "bit", "n"])

    told = values.select("_of", *[f"_w{j}" for j in range(len(places))]).mapInArrow(tally, "j int, p int, bit int, n bigint")
    counts: dict[int, dict[int, dict[str, int]]] = {i: {} for i in shared}
    for r in told.groupBy("j", "p", "bit").agg(F.sum("n").alias("n")).collect():  # a row per group and aggregate
        i, w = places[r["p"]]
        counts[i].setdefault(w * a_word + r["bit"] // width, {})[lots[r["j"]][r["bit"] % width][0]] = r["n"]
    out = []
    for i, by in enumerate(groupings):
        if i not in counts:
            out.append(distinct_counts(df.where(keys[i][1].isNotNull()), by, wanted))
            continue
        named = df.select(*[c.alias(k) for k, c in by.items()]).schema if by else T.StructType()
        groups = sorted(counts[i]) if by else [0]
        columns = {**({keys[i][0]: found[i].column(0).take(pa.array(groups, pa.int64()))} if by else {}),
                   **{n: pa.array([counts[i].get(g, {}).get(n, 0) for g in groups], pa.int64()) for n in wanted}}
        out.append(spark.createDataFrame(pa.table(columns), reduce(lambda s, n: s.add(n, T.LongType()), wanted, named)))
    return out


def spec_problems(df: DataFrame, measures: Mapping[str, Measure]) -> dict[str, str]:
    """The measures that ``check`` refuses, each with the reason."""
    found = {}
    for name, measure in measures.items():
        try:
            check(df, {name: measure})
        except SpecError as error:
            found[name] = str(error)
    return found


def _leaves(measures: Mapping[str, Measure]) -> tuple[dict[str, Aggregate], dict[str, str]]:
    """The aggregates of measures by their text, each once, and a column name for each."""
    leaves: dict[str, Aggregate] = {}
    for measure in measures.values():
        for leaf in measure.aggregates():
            leaves.setdefault(leaf.text, leaf)
    return leaves, {text: f"_a{i}" for i, text in enumerate(leaves)}


def distinct_leaves(measures: Mapping[str, Measure]) -> dict[str, Aggregate]:
    """The distinct counts that measures need, by the names ``evaluate`` has for them."""
    leaves, names = _leaves(measures)
    return {names[t]: leaf for t, leaf in leaves.items() if leaf.fn == "COUNT_DISTINCT"}


def evaluate(
    df: DataFrame,
    measures: Mapping[str, Measure],
    by: Mapping[str, Column] | None = None,
    where: Column | None = None,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """All measures over one base, per group: one row per group, one double per measure.

    Rows without a group value are left out. Distinct counts and medians take a pass of their own
    each, over counted values, as an aggregate would hold every distinct value in one task.
    ``distinct`` are the distinct counts of ``distinct_leaves``, if they have been made before.
    """
    by = dict(by or {})
    if where is not None:
        df = df.where(where)
    for key in by.values():
        df = df.where(key.isNotNull())

    leaves, names = _leaves(measures)
    apart = {fn: {t: leaf for t, leaf in leaves.items() if leaf.fn == fn} for fn in ("MEDIAN", "COUNT_DISTINCT")}
    plain = [leaf.column().alias(names[t]) for t, leaf in leaves.items() if leaf.fn not in apart]

    keys = [c.alias(k) for k, c in by.items()]
    parts = []
    if plain or by:
        plain = plain or [F.count(F.lit(1)).alias("_rows")]
        parts.append(df.groupBy(*keys).agg(*plain) if by else df.agg(*plain))
    if apart["COUNT_DISTINCT"]:
        parts.append(distinct_counts(df, by, distinct_leaves(measures)) if distinct is None else distinct)
    if apart["MEDIAN"]:
        values = {names[t]: leaf.rows() for t, leaf in apart["MEDIAN"].items()}
        keyed = df.select(*keys, *[v.alias(n) for n, v in values.items()])
        parts.append(grouped_quantiles(keyed, list(by), {n: F.col(n) for n in values}, 0.5))
    if len(parts) == 1:
        wide = parts[0]
    else:
        wide = parts[0]
        for part in parts[1:]:
            wide = wide.unionByName(part, allowMissingColumns=True)
        counted = {names[t] for t in apart["COUNT_DISTINCT"]}
        merged = [(F.coalesce(F.max(n), F.lit(0)) if n in counted else F.max(n)).alias(n) for n in names.values()]
        wide = wide.groupBy(*by).agg(*merged) if by else wide.agg(*merged)

    return wide.select(
        *by, *[finite(m.column(lambda a: F.col(names[a.text]))).alias(n) for n, m in measures.items()]
    )


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per KPI: ``keys + (kpi, value)``."""
    return df.unpivot(keys, names, "kpi", "value")


def grouped(
    df: DataFrame,
    measures: Mapping[str, Measure],
    dimension: Column,
    where: Column | None = None,
    limit: int | None = None,
    totals: bool = False,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """Measures by one dimension: ``(kpi, dimension, value)``, and ``rank`` when limited.

    Rank 1 is the largest; ties go to the smaller dimension text. The rank filter keeps at
    most ``limit`` rows per task and KPI before the shuffle. ``totals`` adds the number of
    groups and the sum of their absolute values, over all groups and not just those kept.
    """
    wide = evaluate(df, measures, {"dimension": dimension.cast("string")}, where, distinct)
    rows = to_long(wide, ["dimension"], list(measures))
    if limit is None:
        return rows
    order = Window.partitionBy("kpi").orderBy(F.col("value").desc_nulls_last(), "dimension")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    if not totals:
        return top
    whole = rows.groupBy("kpi").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.abs(F.coalesce("value", F.lit(0.0)))).alias("total"))
    return top.join(whole, "kpi").select("kpi", "dimension", "value", "rank", "segments", "total")


def first_dimension(df: DataFrame, dimensions: Sequence[str | Column]) -> int | None:
    """The place of the first dimension that has a value on any row: the one that a breakdown has rows for.

    One reading for all of them, and none where there is no choice. Groups exist for every measure
    of a base alike, since conditions are inside the measures.
    """
    if len(dimensions) < 2:
        return 0 if dimensions else None
    found = df.agg(*[F.max(as_column(d).isNotNull()).alias(f"d{i}") for i, d in enumerate(dimensions)]).first()
    return next((i for i in range(len(dimensions)) if found[f"d{i}"]), None)
