"""Helpers to evaluate a sub-expression once and reuse it.

Catalyst may inline a column into the place that uses it, and inside a lambda that means once per
array element. Binding the value through a one-element ``transform`` fixes the number of
evaluations at one per row, whatever the optimizer does with the surrounding projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Env = dict[str, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def named(fields: Env) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def staged(env: Env, *steps: Callable[[Env], Env], result: Callable[[Env], Column]) -> Column:
    """Run ``steps`` in order; each sees the earlier names and adds its own."""
    if not steps:
        return result(env)
    fresh = steps[0](env)
    return let(
        named(fresh),
        lambda bound: staged(
            {**env, **{name: bound[name] for name in fresh}}, *steps[1:], result=result
        ),
    )


def empty(ddl: str) -> Column:
    """An empty array of the given element type."""
    return F.expr(f"cast(array() as array<{ddl}>)")


def null(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def first_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, lambda x: test(x)), F.lit(0))


def last_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(array, lambda x: test(x)), F.lit(-1))


def upto(n: Column) -> Column:
    """``0 .. n-1`` as an array, empty for ``n <= 0`` or NULL."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        empty("bigint")
    )


#: Loops that are nested in a walk.
LEVELS = 3


def _rounds(most: Column) -> Column:
    """Rounds of each of the loops of a walk of at most ``most`` steps."""
    return F.sequence(F.lit(1), F.greatest(F.ceil(F.cbrt(most)).cast("int"), F.lit(1)))


def repeat(state: Column, going: Callable[[Column], Column], step: Callable[[Column], Column], most: Column) -> Column:
    """``step`` applied to ``state`` while ``going`` holds, which it may do at most ``most`` times.

    Loops are nested, and each is entered only while there is work, so a short walk costs a few empty rounds.
    """

    def level(k: int, acc: Column, rounds: Column) -> Column:
        inner = step if k == 1 else (lambda x: level(k - 1, x, rounds))
        return F.aggregate(rounds, acc, lambda x, _i: F.when(going(x), inner(x)).otherwise(x))

    return let(_rounds(most), lambda rounds: level(LEVELS, state, rounds))


def gather(
    state: Column, going: Callable[[Column], Column], step: Callable[[Column], Column], item: str, most: Column
) -> Column:
    """``struct(state, out)`` after ``step`` was applied while ``going`` holds, which it may do at most ``most`` times.

    ``step`` gives ``struct(state, item)``; the items that aren't NULL, of type ``item``, are listed in ``out``. Every
    level lists the results of the level below, of which the last one has the state. ``most`` comes from the bytes
    there are, and a level has its cube root of rounds, so a short walk has few empty rounds and lists stay short.
    """

    def level(k: int, acc: Column, rounds: Column) -> Column:
        first, name = (null(item), "item") if k == 1 else (empty(item), "out")
        inner = step if k == 1 else (lambda x: level(k - 1, x, rounds))

        def turn(x: Column) -> Column:
            last = F.element_at(x, -1)["state"]
            return F.when(going(last), F.concat(x, F.array(inner(last)))).otherwise(x)

        def listed(x: Column) -> Column:
            found = F.transform(x, lambda r: r[name])
            return F.struct(
                F.element_at(x, -1)["state"].alias("state"),
                (F.array_compact(found) if k == 1 else F.flatten(found)).alias("out"),
            )

        zero = F.array(F.struct(acc.alias("state"), first.alias(name)))
        return F.aggregate(rounds, zero, lambda x, _i: turn(x), listed)

    return let(_rounds(most), lambda rounds: level(LEVELS, state, rounds))


def _onto(acc: Column, state: Column, item: Column) -> Column:
    return F.struct(state.alias("state"), F.concat(acc["out"], F.array_compact(F.array(item))).alias("out"))


def scanned(values: Column, state: Column, step: Callable[[Column, Column], Column], item: str) -> Column:
    """The items of ``step(state, value)`` = ``struct(state, item)`` along an array, slice by slice.

    Slices are as long as there are slices, which bounds the copies of growing lists.
    """

    def run(part: Column, acc: Column, kind: str, turn: Callable[[Column, Column], Column]) -> Column:
        zero = F.struct(acc.alias("state"), empty(kind).alias("out"))
        return F.aggregate(part, zero, lambda x, v: let(turn(x["state"], v), lambda s: _onto(x, s["state"], s["item"])))

    def sliced(bound: Column) -> Column:
        each = F.greatest(F.ceil(F.sqrt(F.size(bound))).cast("int"), F.lit(1))

        def inner(acc: Column, k: Column) -> Column:
            part = F.slice(bound, (k * each + 1).cast("int"), each)
            return let(run(part, acc, item, step), lambda s: F.struct(s["state"].alias("state"), s["out"].alias("item")))

        return F.flatten(run(upto(F.ceil(F.size(bound) / each)), state, f"array<{item}>", inner)["out"])

    return let(values, sliced)


Step = tuple[str, Column]


def step_columns(
    env: Env, *steps: Callable[[Env], Env], out: str, result: Callable[[Env], Column]
) -> list[Step]:
    """Like ``staged`` with one column per step; the last column is ``out``.

    Each step binds what it uses once per row, so inlining by the optimizer cannot move a step into
    a lambda of the next one, and no expression gets deeper than one step. The columns refer to
    names only, so a list can be built once and applied to many frames.
    """
    seen = dict(env)
    made: list[Step] = []
    for index, step in enumerate(steps):
        name = f"_{out}_{index}"
        fresh: list[str] = []

        def body(bound: Column, step=step, fresh=fresh, seen=seen) -> Column:
            values = step({key: bound[key] for key in seen})
            fresh.extend(values)
            return named(values)

        made.append((name, let(named(seen), body)))
        seen = {**seen, **{key: F.col(name)[key] for key in fresh}}
    final = let(named(seen), lambda bound: result({key: bound[key] for key in seen}))
    return [*made, (out, fence(final))]


def fence(value: Column) -> Column:
    """The same value, but never duplicated by the optimizer.

    A filter above a projection is pushed below it by copying the expressions it reads, step by
    step, which multiplies a long chain. A test on the partition id, always true but not known to be
    so, keeps the chain in one place.
    """
    return F.when(F.spark_partition_id() >= 0, value)


#: Setting of how often the analyzer goes over an expression at most.
ITERATIONS = "spark.sql.analyzer.maxIterations"


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Add the columns of ``steps`` in order.

    The analyzer resolves nested functions from the inside, one level in about two of its iterations.
    """
    conf = df.sparkSession.conf
    before = conf.get(ITERATIONS)
    conf.set(ITERATIONS, str(max(int(before), 400)))
    try:
        for name, column in steps:
            df = df.withColumn(name, column)
    finally:
        conf.set(ITERATIONS, before)
    return df


_built: dict[tuple, list[Step]] = {}


def cached_steps(key: str, build: Callable[[], list[Step]]) -> list[Step]:
    """Build a step list once per session context; building is the slow part of a plan."""
    context = SparkSession.active().sparkContext.applicationId
    full = (context, key)
    if full not in _built:
        _built[full] = build()
    return _built[full]
