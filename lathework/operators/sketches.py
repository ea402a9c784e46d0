"""Roll-ups that can be stored and rolled up again: counts, sums, sketches of distinct values and of distributions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of HyperLogLog with 2**12 registers; the standard error is 1.04 / sqrt(2**12), 1.6 %.
REGISTERS_LOG2 = 12


@dataclass(frozen=True)
class Rollup:
    """What a stored roll-up holds: the levels it is grouped by and its measures by name.

    counts: conditions (None: all rows); sums: whole numbers or decimals, whose sums don't depend on their order; distinct: values whose
    number is estimated; spread: numbers whose quantiles are.
    """

    levels: dict[str, Column]
    counts: dict[str, Column | None] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    distinct: dict[str, Column] = field(default_factory=dict)
    spread: dict[str, Column] = field(default_factory=dict)

    def built(self, rows: DataFrame) -> DataFrame:
        """One row for each combination of all levels; sketches are binary columns, to be written as they are."""
        measures = [(F.count("*") if c is None else F.count_if(c)).alias(n) for n, c in self.counts.items()]
        measures += [F.sum(c).alias(n) for n, c in self.sums.items()]
        measures += [F.hll_sketch_agg(c, F.lit(REGISTERS_LOG2)).alias(n) for n, c in self.distinct.items()]
        measures += [F.kll_sketch_agg_double(c.cast("double")).alias(n) for n, c in self.spread.items()]
        return rows.groupBy(*(c.alias(n) for n, c in self.levels.items())).agg(*measures)

    def rolled_up(self, stored: DataFrame, levels: list[str]) -> DataFrame:
        """A stored roll-up at fewer levels: the same columns, merged; the rows behind it are not read. No level: one row."""
        unknown = set(levels) - set(self.levels)
        if unknown:
            raise ValueError(f"the roll-up has no level {sorted(unknown)}")
        measures = [F.sum(n).alias(n) for n in (*self.counts, *self.sums)]
        measures += [F.hll_union_agg(n).alias(n) for n in self.distinct]
        measures += [F.kll_merge_agg_double(n).alias(n) for n in self.spread]
        return stored.groupBy(*levels).agg(*measures)

    def answers(self, stored: DataFrame, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
        """Estimates instead of the sketches: the distinct numbers by their names, quantiles as name_p50 and so on."""
        out = {n: F.hll_sketch_estimate(n) for n in self.distinct}
        out |= {f"{n}_p{round(100 * q)}": F.kll_sketch_get_quantile_double(F.col(n), F.lit(q)) for n in self.spread for q in quantiles}
        return stored.withColumns(out).drop(*self.spread)
