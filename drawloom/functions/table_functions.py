"""Table functions for SQL, for use with LATERAL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and definition; all are expressions of Spark's own.
DEFINITIONS = {
    "t_subsets": """(numbers ARRAY<BIGINT>, t INT) RETURNS TABLE (subset ARRAY<BIGINT>)
        RETURN SELECT explode(filter(transform(sequence(0, shiftleft(1, size(numbers)) - 1), m -> filter(numbers, (x, i) -> getbit(m, i) = 1)), s -> size(s) = t))""",
    "combinations": """(n INT, k INT) RETURNS TABLE (numbers ARRAY<BIGINT>)
        RETURN SELECT explode(aggregate(sequence(1, k), array(cast(array() AS ARRAY<BIGINT>)),
          (made, i) -> flatten(transform(made, c -> transform(filter(sequence(1L, cast(n AS BIGINT)), x -> (i = 1 OR x > coalesce(get(c, i - 2), 0L)) AND x <= n - k + i), x -> array_append(c, x))))))""",
}


def register(spark: SparkSession) -> None:
    """Make ``t_subsets(numbers, t)``, one row a subset of t of up to 20 numbers, and ``combinations(n, k)``, one row a combination, known to the session.

    ``combinations`` makes its rows from one array: for games of up to some
    100,000 combinations; beyond, ``operators.universe.outcomes`` makes them in
    blocks.
    """
    for name, definition in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {definition}")
