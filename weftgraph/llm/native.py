"""Helpers for operators made of DataFrame functions only: local values, match positions, tails of distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Lengths that one partial sum covers.
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the optimiser would put a plain expression into every use, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, word>> of the leftmost non-overlapping matches, start in code points; empty without any.

    The pieces between the matches give the positions; partial sums over STEP of them keep many matches affordable.
    """
    nothing = F.array().cast("array<struct<start:int,word:string>>")

    def positions(own: Column) -> Column:
        found, gaps = own["found"], own["gaps"]
        steps = F.transform(found, lambda word, i: F.length(word) + F.length(gaps[i]))

        def placed(sums: Column) -> Column:
            def total(values: Column) -> Column:
                return F.aggregate(values, F.lit(0), lambda a, b: a + b)

            def at(word: Column, i: Column) -> Column:
                block = F.floor(i / STEP).cast("int")
                before = total(F.slice(sums["blocks"], F.lit(1), block)) + total(F.slice(sums["steps"], block * STEP + 1, i % STEP))
                return F.struct((before + F.length(gaps[i])).alias("start"), word.alias("word"))

            return F.transform(found, at)

        def with_blocks(steps: Column) -> Column:
            count = F.ceil(F.size(steps) / STEP).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(F.slice(steps, b * STEP + 1, F.lit(STEP)), F.lit(0), lambda a, c: a + c))
            return F.struct(steps.alias("steps"), blocks.alias("blocks"))

        return let(let(steps, with_blocks), placed)

    own = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(own, positions)).otherwise(nothing)


def through(x: Column, steps: Sequence[Callable]) -> Column:
    """The struct that the last step makes of a struct. A step gives names and columns from what the one before gave."""
    if not steps:
        return x
    return let(F.struct(*(value.alias(name) for name, value in steps[0](x).items())), lambda y: through(y, steps[1:]))


def table_through(table: DataFrame, steps: Sequence[Callable], apart: Sequence[Callable] = ()) -> DataFrame:
    """The same for the rows of a table, several times as fast, as what stands in no lambda is compiled.

    Spark makes one method of all steps, and the JVM compiles none above 8,000 bytes: large steps go apart, as a local
    value keeps them out of it.
    """
    for step in steps:
        columns = step(table)
        if step in apart:
            columns |= {name: let(value, lambda v: v) for name, value in list(columns.items())[:1]}
        table = table.select(*(value.alias(name) for name, value in columns.items()))
    return table


# P(Z > z) of a standard normal variable, to 1e-7 (a polynomial in t = 1 / (1 + 0.2316419 |z|)): the side, or 1 less the side below 0.


def tail_share(z: Column) -> Column:
    return 1 / (1 + 0.2316419 * F.abs(z))


def tail_side(z: Column, t: Column) -> Column:
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


# P(X > x) of a chi-squared variable by the cube-root transformation to a normal one.


def chi_squared_spread(df: Column) -> Column:
    return F.lit(2.0) / (9 * df)


def chi_squared_deviation(x: Column, df: Column, spread: Column) -> Column:
    return (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
