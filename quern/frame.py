"""An ordered, index-aware data-frame API over Spark DataFrames.

A `Frame` holds a Spark DataFrame, the names of its index columns and of the column that
orders its rows. All methods are lazy and give new frames, except those that must look at
the data, which say so. A `Series` is a column expression on a frame, so arithmetic,
comparisons, string and date methods become one projection.

    f = Frame(spark.read.parquet(path), order="o_orderkey")
    f[f["o_totalprice"] > 1000].groupby("o_custkey").agg(total=("o_totalprice", "sum"))
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import dates, elementwise, strings
from quern.operators import aligned, arrays, combine, convert, expressions, grouping, joins, missing, order, reshape, stats, udf, windows
from quern.operators.grouping import REDUCE
from quern.sources import readers, writers

_ORDER = "__ord"


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x or [])


class Frame:
    def __init__(self, sdf: DataFrame, index: list[str] | str | None = None, order: str | None = None):
        self.sdf, self.index = sdf, _list(index)
        self.order = order or (_ORDER if _ORDER in sdf.columns else None)

    # Order and shape.

    def ordered(self) -> Frame:
        """With an order: the one given, or that of the scan (stable as long as the input is)."""
        if self.order:
            return self
        return Frame(self.sdf.withColumn(_ORDER, F.monotonically_increasing_id()), self.index, _ORDER)

    def _of(self, sdf: DataFrame, index: list[str] | None = None) -> Frame:
        return Frame(sdf, self.index if index is None else index, self.order if self.order in sdf.columns else None)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.sdf.columns if c not in self.index and c != _ORDER]

    keys = columns

    @property
    def dtypes(self) -> dict[str, str]:
        return {c: t for c, t in self.sdf.dtypes if c in self.columns}

    @property
    def shape(self) -> tuple[int, int]:
        """Counts the rows."""
        return self.sdf.count(), len(self.columns)

    @property
    def empty(self) -> bool:
        """Looks for a row."""
        return self.sdf.limit(1).count() == 0

    def __len__(self) -> int:
        return self.sdf.count()

    def copy(self) -> Frame:
        return self._of(self.sdf)

    def explain(self, mode: str = "formatted") -> None:
        self.sdf.explain(mode)

    # Selection and assignment.

    def __getitem__(self, item):
        if isinstance(item, str):
            return Series(self, F.col(f"`{item}`"), item)
        if isinstance(item, Series):
            return self._of(self.sdf.filter(F.coalesce(item.column, F.lit(False))))
        if isinstance(item, slice):
            return self.iloc(item.start, item.stop)
        return self._of(self.sdf.select([c for c in self.sdf.columns if c in self.index or c == self.order and c == _ORDER] + list(item)))

    def assign(self, **values) -> Frame:
        out = self
        for name, v in values.items():
            v = v(out) if callable(v) and not isinstance(v, Column) else v
            out = out._of(out.sdf.withColumn(name, v.column if isinstance(v, Series) else v if isinstance(v, Column) else F.lit(v)))
        return out

    def insert(self, loc: int, name: str, value) -> Frame:
        out = self.assign(**{name: value})
        rest = [c for c in self.columns]
        return out._of(out.sdf.select([c for c in out.sdf.columns if c not in out.columns] + [*rest[:loc], name, *rest[loc:]]))

    def drop(self, columns=None, labels=None) -> Frame:
        out = self.sdf.drop(*_list(columns))
        if labels is not None:
            out = out.filter(~F.col(self.index[0]).isin(list(labels)))
        return self._of(out)

    def pop(self, name: str) -> tuple[Series, Frame]:
        return self[name], self.drop(name)

    def rename(self, columns: dict | None = None) -> Frame:
        names = columns if isinstance(columns, dict) else {c: columns(c) for c in self.columns}
        out = Frame(self.sdf.withColumnsRenamed(names), [names.get(c, c) for c in self.index], names.get(self.order, self.order))
        return out

    def add_prefix(self, prefix: str) -> Frame:
        return self.rename({c: prefix + c for c in self.columns})

    def add_suffix(self, suffix: str) -> Frame:
        return self.rename({c: c + suffix for c in self.columns})

    def set_axis(self, labels: list[str]) -> Frame:
        return self.rename(dict(zip(self.columns, labels, strict=True)))

    def set_index(self, keys, append: bool = False) -> Frame:
        return self._of(self.sdf, (self.index if append else []) + _list(keys))

    def reset_index(self, drop: bool = False, name: str = "index") -> Frame:
        """Index columns become values (or go); without an index, row numbers become a column."""
        if self.index:
            return self._of(self.sdf.drop(*self.index) if drop else self.sdf, [])
        return self if drop else self.positions(name)

    def positions(self, name: str = "position") -> Frame:
        f = self.ordered()
        return f._of(windows.positions(f.sdf, f.order, name=name))

    def loc(self, labels=None, columns=None, start=None, stop=None) -> Frame:
        """Rows by index labels, or from one label to another, both included; a boolean series as well."""
        out = self
        if isinstance(labels, Series):
            out = out[labels]
        elif labels is not None:
            out = out._of(out.sdf.filter(F.col(self.index[0]).isin(labels if isinstance(labels, list) else [labels])))
        if start is not None:
            out = out._of(out.sdf.filter(F.col(self.index[0]) >= start))
        if stop is not None:
            out = out._of(out.sdf.filter(F.col(self.index[0]) <= stop))
        return out[_list(columns)] if columns else out

    def iloc(self, start=None, stop=None) -> Frame:
        """Rows by position; negative ones count from the end (which counts the rows)."""
        if not start and stop is not None and stop >= 0:
            return self.head(stop)
        n = len(self) if (start or 0) < 0 or (stop is not None and stop < 0) else 0
        lo, hi = (start or 0) + (n if (start or 0) < 0 else 0), None if stop is None else stop + (n if stop < 0 else 0)
        p = self.positions("__p")
        keep = F.col("__p") >= lo if hi is None else (F.col("__p") >= lo) & (F.col("__p") < hi)
        return p._of(p.sdf.filter(keep).drop("__p"))

    def at(self, label, column: str):
        """Fetches a value."""
        row = self.sdf.filter(F.col(self.index[0]) == label).select(column).first()
        return row[0] if row else None

    def iat(self, i: int, column: str):
        """Fetches a value."""
        row = self.iloc(i, i + 1 if i != -1 else None).sdf.select(column).first()
        return row[0] if row else None

    def head(self, n: int = 5) -> Frame:
        f = self.ordered()
        return f._of(order.head(f.sdf, [f.order], n))

    def tail(self, n: int = 5) -> Frame:
        f = self.ordered()
        return f._of(order.tail(f.sdf, [f.order], n))

    def sample(self, frac: float, replace: bool = False, seed: int | None = None) -> Frame:
        return self._of(self.sdf.sample(replace, frac, seed))

    def query(self, text: str, **local) -> Frame:
        return self._of(expressions.query(self.sdf, text, local))

    def eval(self, text: str, **local) -> Frame:
        return self._of(expressions.eval_(self.sdf, text, local))

    def select_dtypes(self, include) -> Frame:
        names = convert.select_dtypes(self.sdf.select(self.columns), _list(include)).columns
        return self[names]

    def astype(self, types, errors: str = "raise") -> Frame:
        return self._of(convert.astype(self.sdf, types if isinstance(types, dict) else {c: types for c in self.columns}, errors))

    # Missing data and values.

    def fillna(self, value) -> Frame:
        return self._of(missing.fillna(self.sdf, value))

    def dropna(self, how: str = "any", thresh: int | None = None, subset=None) -> Frame:
        return self._of(missing.dropna(self.sdf, how, thresh, _list(subset) or self.columns))

    def isna(self) -> Frame:
        return self._map(missing.isna)

    def notna(self) -> Frame:
        return self._map(missing.notna)

    def replace(self, to_replace, value=None) -> Frame:
        return self._of(missing.replace(self.sdf, to_replace, value, self.columns))

    def where(self, cond: Series, other=None) -> Frame:
        return self._map(lambda c: missing.where(cond.column, F.col(c), other))

    def mask(self, cond: Series, other=None) -> Frame:
        return self._map(lambda c: missing.mask(cond.column, F.col(c), other))

    def isin(self, values: list) -> Frame:
        return self._map(lambda c: F.coalesce(F.col(c).isin(values), F.lit(False)))

    def ffill(self) -> Frame:
        f = self.ordered()
        return f._of(windows.cumulative(f.sdf, f.order, **{f"__f_{c}": (c, "ffill") for c in f.columns if c != f.order}).drop(*[c for c in f.columns if c != f.order]).withColumnsRenamed({f"__f_{c}": c for c in f.columns}))

    def _map(self, f) -> Frame:
        return self._of(self.sdf.withColumns({c: f(c) for c in self.columns if c != self.order}))

    def abs(self) -> Frame:
        return self._map(lambda c: F.abs(F.col(c)))

    def round(self, decimals: int = 0) -> Frame:
        return self._map(lambda c: F.bround(F.col(c), decimals))

    # Combination.

    def merge(self, right: Frame, how: str = "inner", on=None, left_on=None, right_on=None, suffixes=("_x", "_y"), indicator: bool = False) -> Frame:
        return Frame(joins.merge(self.sdf.drop(_ORDER), right.sdf.drop(_ORDER), how, on, left_on, right_on, suffixes, indicator))

    def join(self, other: Frame, on=None, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> Frame:
        """On the index of the other frame, and on this one's index or columns."""
        keys = _list(on) or self.index
        right = other.sdf.drop(_ORDER).withColumnsRenamed(dict(zip(other.index, keys, strict=True)))
        out = joins.merge(self.sdf.drop(_ORDER), right, how, on=keys, suffixes=(lsuffix, rsuffix))
        return Frame(out, self.index)

    def merge_asof(self, right: Frame, on: str, by=None, columns=None, direction: str = "backward") -> Frame:
        return Frame(joins.asof(self.sdf, right.sdf, on, _list(by), _list(columns) or [c for c in right.columns if c not in _list(by) + [on]], direction))

    def append(self, other: Frame) -> Frame:
        return Frame(combine.append(self.sdf.drop(_ORDER), other.sdf.drop(_ORDER)), self.index)

    def drop_duplicates(self, subset=None, keep: str | bool = "first") -> Frame:
        f = self.ordered()
        return f._of(combine.drop_duplicates(f.sdf, _list(subset) or [c for c in f.columns if c != f.order], [f.order], keep))

    def duplicated(self, subset=None, keep: str | bool = "first") -> Frame:
        f = self.ordered()
        return f._of(combine.duplicated(f.sdf, _list(subset) or [c for c in f.columns if c != f.order], [f.order], keep))

    def reindex(self, labels: list, fill_value=None) -> Frame:
        """A row per label, in their order."""
        name = self.index[0]
        wanted = self.sdf.sparkSession.createDataFrame(list(enumerate(labels)), f"`{_ORDER}` long, `{name}` {self.sdf.schema[name].dataType.simpleString()}")
        out = wanted.join(self.sdf.drop(_ORDER).withColumn("__there", F.lit(True)), name, "left")
        if fill_value is not None:
            out = out.withColumns({c: F.when(F.col("__there").isNull(), F.lit(fill_value)).otherwise(F.col(c)) for c in self.columns})
        return Frame(out.drop("__there"), [name], _ORDER)

    def align(self, other: Frame, join: str = "outer") -> tuple[Frame, Frame]:
        """Both frames on the united (or shared) index labels and columns."""
        how = {"outer": "full", "inner": "inner", "left": "left", "right": "right"}[join]
        labels = self.sdf.select(self.index).join(other.sdf.select(other.index), self.index, how).distinct()
        names = sorted(set(self.columns) | set(other.columns)) if join == "outer" else [c for c in self.columns if c in other.columns]

        def fit(f: Frame) -> Frame:
            out = labels.join(f.sdf.drop(_ORDER), self.index, "left")
            return Frame(out.select(*self.index, *[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in names]), self.index)

        return fit(self), fit(other)

    def reindex_like(self, other: Frame) -> Frame:
        """The rows of the other frame's labels, in its order, and its columns."""
        there = other.ordered()
        rows = there.sdf.select(*there.index, F.col(there.order).alias(_ORDER)).join(self.sdf.drop(_ORDER), there.index, "left")
        return Frame(rows.select(*there.index, *[F.col(f"`{c}`") if c in self.columns else F.lit(None).alias(c) for c in other.columns if c != there.order], _ORDER), there.index, _ORDER)

    def combine_first(self, other: Frame) -> Frame:
        """The values of this frame, and of the other where they are missing."""
        return Frame(aligned.combine_first(self._values(), other._values(), self.index), self.index)

    def corrwith(self, other: Frame) -> Frame:
        return Frame(aligned.corrwith(self._values(), other._values(), self.index))

    def _values(self) -> DataFrame:
        return self.sdf.select([c for c in self.sdf.columns if c != _ORDER])

    def _binary(self, function, other, fill_value=None, reflected: bool = False) -> Frame:
        """With a frame, aligned on the index; with a mapping, column by column; with a series of this frame or a value, every column."""
        turned = (lambda a, b: function(b, a)) if reflected else function
        if isinstance(other, Frame):
            return Frame(aligned.combined(self._values(), other._values(), self.index, turned, fill_value), self.index)
        names = [c for c in self.columns if c != self.order]
        if isinstance(other, dict):
            return self._of(self.sdf.withColumns({c: turned(F.col(f"`{c}`"), F.lit(other[c])) if c in other else F.lit(None) for c in names}))
        value = other.column if isinstance(other, Series) else F.lit(other)
        if fill_value is not None:
            return self._of(self.sdf.withColumns({c: turned(F.coalesce(F.col(f"`{c}`"), F.lit(fill_value)), value) for c in names}))
        return self._of(self.sdf.withColumns({c: turned(F.col(f"`{c}`"), value) for c in names}))

    def apply_columns(self, function, columns=None) -> Frame:
        """A function of each numeric column."""
        return self._of(self.sdf.withColumns({c: function(F.col(f"`{c}`")) for c in _list(columns) or [c for c in self.select_dtypes("number").columns if c not in (*self.index, self.order)]}))

    def clip(self, lower=None, upper=None, columns=None) -> Frame:
        def held(c: Column) -> Column:
            c = c if lower is None else F.when(c < lower, F.lit(lower)).otherwise(c)
            return c if upper is None else F.when(c > upper, F.lit(upper)).otherwise(c)

        return self.apply_columns(held, columns)

    def abs(self, columns=None) -> Frame:
        return self.apply_columns(F.abs, columns)

    def round(self, decimals: int = 0, columns=None) -> Frame:
        return self.apply_columns(lambda c: elementwise.rint(c * 10**decimals) / 10**decimals, columns)

    def rank(self, columns=None, method: str = "average", pct: bool = False) -> Frame:
        """Ranks over all rows, by counts of the distinct values; missing ones have none."""
        out = self.sdf
        for c in _list(columns) or [c for c in self.select_dtypes("number").columns if c not in (*self.index, self.order)]:
            out = order.rank_values(out, c, method, pct)
        return self._of(out)

    def xs(self, key, level: str | None = None) -> Frame:
        """The rows of a label, without that index column."""
        name = level or self.index[0]
        return Frame(self.sdf.filter(F.col(f"`{name}`") == key).drop(name), [i for i in self.index if i != name], self.order)

    def truncate(self, before=None, after=None) -> Frame:
        """The rows whose first index label is within the bounds."""
        out, c = self.sdf, F.col(f"`{self.index[0]}`")
        out = out if before is None else out.filter(c >= before)
        return self._of(out if after is None else out.filter(c <= after))

    def unstack(self, labels: list, level: str | None = None) -> Frame:
        """An index column's given labels as columns, `value_label` for each value."""
        name = level or self.index[-1]
        rest, values = [i for i in self.index if i != name], [c for c in self.columns if c != self.order]
        cells = [F.max(F.when(F.col(f"`{name}`") == x, F.col(f"`{v}`"))).alias(f"{v}_{x}") for v in values for x in labels]
        return Frame(self.sdf.groupBy(*rest).agg(*cells), rest)

    def rename_axis(self, names) -> Frame:
        """New names of the index columns: a list, or a mapping of some."""
        names = names if isinstance(names, dict) else dict(zip(self.index, _list(names), strict=True))
        return Frame(self.sdf.withColumnsRenamed(names), [names.get(i, i) for i in self.index], self.order)

    def index_frame(self) -> Index:
        return Index(self)

    def memory_usage(self) -> Frame:
        """(column, bytes) of the values as they are held: strings by their bytes, others by the width of their type."""
        width = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}
        size = lambda f: F.sum(F.octet_length(f.name)) if f.dataType.typeName() == "string" else F.count("*") * width.get(f.dataType.typeName(), 8)
        fields = [f for f in self.sdf.schema if f.name in self.columns]
        sizes = self.sdf.agg(*[F.coalesce(size(f).cast("long"), F.lit(0)).alias(f.name) for f in fields])
        return Frame(sizes.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f.name) for f in fields]), F.array(*[F.col(f"`{f.name}`") for f in fields]))).alias("column", "bytes")))

    # Groups, reductions, statistics.

    def groupby(self, by) -> GroupBy:
        return GroupBy(self, _list(by))

    def agg(self, **named) -> Frame:
        """One row: name=(column, reduction)."""
        return Frame(stats.aggregate(self.sdf, **named))

    def reduce(self, how: str, columns=None) -> Frame:
        return self.agg(**{c: (c, how) for c in _list(columns) or self.select_dtypes("number").columns})

    def describe(self, columns=None) -> Frame:
        return Frame(stats.describe(self.sdf, _list(columns) or self.select_dtypes("number").columns))

    def corr(self, columns=None) -> Frame:
        return Frame(stats.corr_matrix(self.sdf, _list(columns) or self.select_dtypes("number").columns))

    def cov(self, columns=None) -> Frame:
        """(a, b, cov) of each two columns."""
        return Frame(arrays.cov(self.sdf, _list(columns) or self.select_dtypes("number").columns))

    def quantile(self, q: float, columns=None, interpolation: str = "linear") -> Frame:
        names = _list(columns) or self.select_dtypes("number").columns
        return Frame(self.sdf.agg(*[stats.quantile(c, q, interpolation).alias(c) for c in names]))

    # Order and windows.

    def sort_values(self, by, ascending=True, na_position: str = "last") -> Frame:
        return self._of(order.sort_values(self.sdf, _list(by), ascending, na_position))

    def sort_index(self, ascending: bool = True) -> Frame:
        return self._of(order.sort_values(self.sdf, self.index, ascending))

    def nlargest(self, n: int, columns, keep: str = "first") -> Frame:
        f = self.ordered()
        return f._of(order.nlargest(f.sdf, n, _list(columns), keep, [f.order]))

    def nsmallest(self, n: int, columns, keep: str = "first") -> Frame:
        f = self.ordered()
        return f._of(order.nsmallest(f.sdf, n, _list(columns), keep, [f.order]))

    def cumulative(self, **named) -> Frame:
        """Running values over all rows: name=(column, cumsum | cumprod | cummax | cummin | ffill)."""
        f = self.ordered()
        return f._of(windows.cumulative(f.sdf, f.order, **named))

    def rolling(self, window: int, **named) -> Frame:
        """Rolling reductions over all rows: name=(column, reduction)."""
        f = self.positions("__p")
        return f._of(windows.rolling_frame(f.sdf, "__p", window, **named).drop("__p"))

    def shift(self, periods: int = 1, **named) -> Frame:
        f = self.positions("__p")
        return f._of(windows.shift_frame(f.sdf, "__p", periods, **named).drop("__p"))

    # Shape and functions.

    def pivot_table(self, values: str, index, columns: str, labels: list, aggfunc: str = "mean", fill_value=None, margins: bool = False) -> Frame:
        return Frame(reshape.pivot_table(self.sdf, _list(index), columns, values, labels, aggfunc, fill_value, margins), index)

    def pivot(self, index, columns: str, values: str, labels: list) -> Frame:
        return Frame(reshape.pivot(self.sdf, _list(index), columns, values, labels), index)

    def melt(self, id_vars, value_vars, var_name: str = "variable", value_name: str = "value") -> Frame:
        return Frame(reshape.melt(self.sdf, _list(id_vars), _list(value_vars), var_name, value_name))

    def stack(self, dropna: bool = True) -> Frame:
        return Frame(reshape.stack(self.sdf, self.index, [c for c in self.columns if c != self.order], dropna), [*self.index, "level"])

    def explode(self, column: str) -> Frame:
        return self._of(reshape.explode(self.sdf, column))

    def get_dummies(self, column: str, labels: list, **kw) -> Frame:
        return self._of(reshape.get_dummies(self.sdf, column, labels, **kw))

    def apply(self, func, schema: str) -> Frame:
        return Frame(udf.apply_rows(self.sdf, func, schema))

    def map_chunk(self, func, schema: str) -> Frame:
        return Frame(udf.map_chunk(self.sdf, func, schema))

    def rebalance(self, num_partitions: int | None = None) -> Frame:
        return self._of(udf.rebalance(self.sdf, num_partitions))

    def pipe(self, func, *args, **kw):
        return func(self, *args, **kw)

    # Results.

    def to_pandas(self) -> pd.DataFrame:
        """Fetches all rows, in order if the frame has one."""
        out = (self.sdf.orderBy(self.order) if self.order else self.sdf).drop(_ORDER).toPandas()
        return out.set_index(self.index) if self.index else out

    def iterrows(self):
        """Fetches rows partition by partition."""
        names = self.index + self.columns
        for r in (self.sdf.orderBy(self.order) if self.order else self.sdf).select(names).toLocalIterator():
            yield r.asDict()

    def itertuples(self):
        for r in (self.sdf.orderBy(self.order) if self.order else self.sdf).select(self.index + self.columns).toLocalIterator():
            yield tuple(r)

    def to_csv(self, path: str, **kw) -> None:
        writers.to_csv(self.sdf.drop(_ORDER), path, **kw)

    def to_parquet(self, path: str, **kw) -> None:
        writers.to_parquet(self.sdf.drop(_ORDER), path, **kw)

    def to_sql(self, url: str, name: str, **kw) -> None:
        writers.to_sql(self.sdf.drop(_ORDER), url, name, **kw)


class GroupBy:
    """Groups of a frame; rows with a missing key are in none."""

    def __init__(self, frame: Frame, keys: list[str], selected: list[str] | None = None):
        self.frame, self.by, self.selected = frame.ordered(), keys, selected

    def __getitem__(self, columns) -> GroupBy:
        """The groups with some columns alone to reduce."""
        return GroupBy(self.frame, self.by, _list(columns))

    def _order(self) -> list[str]:
        return [self.frame.order]

    def agg(self, **named) -> Frame:
        return Frame(grouping.agg(self.frame.sdf, self.by, **named), self.by)

    def reduce(self, how: str, columns=None) -> Frame:
        names = _list(columns) or self.selected or [c for c in self.frame.select_dtypes("number").columns if c not in self.by and c != self.frame.order]
        return self.agg(**{c: (c, how) for c in names})

    def size(self) -> Frame:
        return self.agg(size=(self.by[0], "size"))

    def transform(self, **named) -> Frame:
        return self.frame._of(grouping.transform(self.frame.sdf, self.by, **named))

    def cumulative(self, **named) -> Frame:
        return self.frame._of(grouping.cumulative(self.frame.sdf, self.by, self._order(), **named))

    def fill(self, column: str, method: str = "ffill") -> Frame:
        return self.frame._of(self.frame.sdf.withColumn(column, grouping.fill(self.frame.sdf, self.by, self._order(), column, method)))

    def head(self, n: int = 5) -> Frame:
        return self.frame._of(grouping.head(self.frame.sdf, self.by, self._order(), n))

    def tail(self, n: int = 5) -> Frame:
        return self.frame._of(grouping.tail(self.frame.sdf, self.by, self._order(), n))

    def nth(self, n, dropna: str | None = None) -> Frame:
        return self.frame._of(grouping.nth(self.frame.sdf, self.by, self._order(), n, dropna))

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 0) -> Frame:
        return self.frame._of(grouping.sample(self.frame.sdf, self.by, n, frac, seed, self.frame.order))

    def rank(self, column: str, method: str = "average", name: str = "rank") -> Frame:
        return self.frame._of(self.frame.sdf.withColumn(name, grouping.rank(self.by, [column], method)))

    def shift(self, column: str, periods: int = 1, name: str = "shifted") -> Frame:
        return self.frame._of(self.frame.sdf.withColumn(name, windows.shift(self.by, self._order(), column, periods)))

    def rolling(self, window: int, column: str, how: str, min_periods: int | None = None, name: str = "rolled") -> Frame:
        return self.frame._of(self.frame.sdf.withColumn(name, windows.rolling(self.by, self._order(), window, column, how, min_periods)))

    def expanding(self, column: str, how: str, name: str = "expanded") -> Frame:
        return self.frame._of(self.frame.sdf.withColumn(name, windows.expanding(self.by, self._order(), column, how)))

    def ewm(self, column: str, how: str = "mean", adjust: bool = True, name: str = "ewm", **decay) -> Frame:
        return self.frame._of(windows.ewm(self.frame.sdf, self.by, self._order(), column, windows.alpha_of(**decay), name, how, adjust))

    def apply(self, func, schema: str) -> Frame:
        return Frame(grouping.apply(self.frame.sdf.drop(_ORDER), self.by, func, schema))


class Index:
    """The index columns of a frame."""

    def __init__(self, frame: Frame):
        self.frame, self.names = frame, list(frame.index)

    def to_frame(self) -> Frame:
        f = self.frame
        return f._of(f.sdf.select([c for c in f.sdf.columns if c in f.index or c == f.order]))

    def to_series(self, name: str = "label") -> Series:
        """The first index column as a series with itself as the index."""
        return Series(self.frame, F.col(f"`{self.names[0]}`"), name)

    def set_names(self, names) -> Frame:
        return self.frame.rename_axis(names)

    def unique(self) -> Frame:
        return Frame(self.frame.sdf.select(self.names).distinct(), self.names)

    def isin(self, values: list) -> Series:
        return self.to_series().isin(values)


class _Methods:
    """Functions of a module as methods of a series."""

    def __init__(self, series: Series, module, names: dict[str, str] | None = None):
        self._series, self._module, self._names = series, module, names or {}

    def __getattr__(self, name: str):
        f = getattr(self._module, self._names.get(name, name))
        return lambda *a, **k: self._series._with(f(self._series.column, *a, **k))


class Series:
    def __init__(self, frame: Frame, column: Column, name: str):
        self.frame, self.column, self.name = frame, column, name

    def _with(self, column: Column) -> Series:
        return Series(self.frame, column, self.name)

    @property
    def str(self) -> _Methods:
        return _Methods(self, strings, {"len": "length", "slice": "slice_"})

    @property
    def dt(self) -> _Methods:
        return _Methods(self, dates, {"round": "round_"})

    @property
    def np(self) -> _Methods:
        """Element-wise array functions."""
        return _Methods(self, elementwise, {"abs": "abs_"})

    def isna(self) -> Series:
        return self._with(missing.isna(self.column))

    def notna(self) -> Series:
        return self._with(missing.notna(self.column))

    def isin(self, values: list) -> Series:
        return self._with(F.coalesce(self.column.isin(list(values)), F.lit(False)))

    def between(self, low, high) -> Series:
        return self._with(F.coalesce(self.column.between(low, high), F.lit(False)))

    def fillna(self, value) -> Series:
        return self._with(F.coalesce(self.column, F.lit(value)))

    def where(self, cond: Series, other=None) -> Series:
        return self._with(missing.where(cond.column, self.column, other))

    def map(self, mapping: dict, default=None) -> Series:
        return self._with(udf.map_values(self.column, mapping, default))

    def apply(self, func, kind: str) -> Series:
        return self._with(udf.map_series(self.column, func, kind))

    def astype(self, kind: str) -> Series:
        return self._with(self.column.cast(kind))

    def rename(self, name: str) -> Series:
        return Series(self.frame, self.column, name)

    def clip(self, low, high) -> Series:
        return self._with(elementwise.clip(self.column, low, high))

    def to_frame(self) -> Frame:
        f = self.frame
        keep = [c for c in f.sdf.columns if c in f.index or c == f.order]
        return f._of(f.sdf.select(*[c for c in keep if c != self.name], self.column.alias(self.name)))

    def value_counts(self, normalize: bool = False, dropna: bool = True) -> Frame:
        return Frame(stats.value_counts(self.to_frame().sdf, self.name, normalize, dropna), [self.name])

    def unique(self) -> Frame:
        return Frame(combine.unique(self.to_frame().sdf, self.name))

    def mode(self) -> Frame:
        return Frame(stats.mode(self.to_frame().sdf, self.name))

    def reduce(self, how: str):
        """Fetches one value."""
        return self.frame.sdf.select(self.column.alias("v")).agg(REDUCE[how]("v")).first()[0]

    def quantile(self, q: float, interpolation: str = "linear"):
        """Fetches one value."""
        return self.frame.sdf.select(self.column.alias("v")).agg(stats.quantile("v", q, interpolation)).first()[0]

    def to_pandas(self) -> pd.Series:
        return self.to_frame().to_pandas()[self.name]


def _operator(name: str, function):
    def call(self: Series, other):
        return self._with(function(self.column, other.column if isinstance(other, Series) else F.lit(other)))

    call.__name__ = name
    setattr(Series, name, call)


def _reflected(name: str, function):
    setattr(Series, name, lambda self, other: self._with(function(F.lit(other), self.column)))


def _of_frames(name: str, function, reflected: bool = False):
    setattr(Frame, name, lambda self, other, fill_value=None: self._binary(function, other, fill_value, reflected))


for _name, _f in aligned.ARITHMETIC.items():
    _operator(f"__{_name}__", _f)
    _operator(_name, _f)
    _reflected(f"__r{_name}__", _f)
    _reflected(f"r{_name}", _f)
    for _at in (f"__{_name}__", _name):
        _of_frames(_at, _f)
    for _at in (f"__r{_name}__", f"r{_name}"):
        _of_frames(_at, _f, reflected=True)
for _name, _f in aligned.COMPARISON.items():
    for _at in (f"__{_name}__", _name):
        _operator(_at, _f)
        _of_frames(_at, _f)
for _name, _alias in (("sub", "subtract"), ("mul", "multiply"), ("truediv", "div"), ("truediv", "divide")):
    for _kind in (Series, Frame):
        setattr(_kind, _alias, getattr(_kind, _name))
        setattr(_kind, f"r{_alias}", getattr(_kind, f"r{_name}"))
Frame.__hash__ = object.__hash__
Frame.__neg__ = lambda self: self.apply_columns(lambda c: -c)
_operator("__and__", lambda a, b: a & b)
_operator("__or__", lambda a, b: a | b)
_operator("__xor__", lambda a, b: a != b)
Series.__invert__ = lambda self: self._with(~self.column)
Series.__neg__ = lambda self: self._with(-self.column)
Series.__abs__ = lambda self: self._with(F.abs(self.column))
Series.__hash__ = object.__hash__
for _name in ("sum", "prod", "max", "min", "count", "mean", "var", "std", "sem", "skew", "kurt", "all", "any", "nunique", "median"):
    setattr(Series, _name, lambda self, how=_name: self.reduce(how))
    setattr(Frame, _name, lambda self, columns=None, how=_name: self.reduce(how, columns))
    setattr(GroupBy, _name, lambda self, columns=None, how=_name: self.reduce(how, columns))


for _name in ("cumsum", "cumprod", "cummax", "cummin"):
    setattr(Frame, _name, lambda self, columns=None, how=_name: self.cumulative(**{c: (c, how) for c in _list(columns) or [c for c in self.select_dtypes("number").columns if c not in (*self.index, self.order)]}))


def concat(frames: list[Frame], join: str = "outer", keys: list[str] | None = None) -> Frame:
    return Frame(combine.concat([f.sdf.drop(_ORDER) for f in frames], join, keys), frames[0].index)


def read_parquet(spark: SparkSession, path, columns=None, order: str | None = None) -> Frame:
    return Frame(readers.read_parquet(spark, path, columns), order=order)


def read_csv(spark: SparkSession, path, order: str | None = None, **kw) -> Frame:
    return Frame(readers.read_csv(spark, path, **kw), order=order)


def from_pandas(spark: SparkSession, data: pd.DataFrame) -> Frame:
    """The frame with its row numbers as the order."""
    plain = data.reset_index(drop=True)
    return Frame(missing.normalise(spark.createDataFrame(plain.assign(**{_ORDER: range(len(plain))}))), order=_ORDER)
