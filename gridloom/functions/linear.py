"""Small linear systems as column expressions."""

from pyspark.sql import functions as F


def _let(value, use):
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def solve(matrix, n, tiny=1e-9):
    """Solution of n symmetric equations given as rows of n + 1 numbers (the last one: right side).

    Gauss-Jordan elimination with row pivoting.  An unknown whose pivot is below
    ``tiny`` times the largest entry adds nothing to the others and becomes 0.
    """
    size = F.array_max(F.transform(matrix, lambda r: F.array_max(F.transform(F.slice(r, 1, n), F.abs))))

    def eliminate(m, k):
        rest = F.transform(F.sequence(k, F.lit(n - 1)), lambda i: F.struct(F.abs(F.get(F.get(m, i), k)).alias("size"), (-i).alias("at")))
        pick = F.array_max(rest)

        def with_pivot(p):
            row = F.get(m, -p["at"])
            scaled = F.transform(row, lambda v: v / F.get(row, k))

            def step(s):
                def one(r, i):
                    own = F.when(i == -p["at"], F.get(m, k)).otherwise(r)
                    return F.when(i == k, s).otherwise(F.zip_with(own, s, lambda a, b: a - F.get(own, k) * b))

                return F.transform(m, one)

            return F.when(p["size"] > tiny, _let(scaled, step)).otherwise(m)

        return _let(pick, with_pivot)

    unit = F.transform(matrix, lambda r: F.transform(r, lambda v: v / F.when(size > 0, size).otherwise(1.0)))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), unit, eliminate)
    return F.transform(done, lambda r, i: F.when(F.abs(F.get(r, i) - 1.0) < 1e-6, F.get(r, F.lit(n))).otherwise(0.0))


def normal_equations(basis, value):
    """Aggregates of a least-squares fit: ({name: sum}, matrix of the named sums) for basis columns and a value column."""
    sums = {}
    for i, a in enumerate(basis):
        for j, b in enumerate(basis[i:], i):
            sums[f"_g{i}_{j}"] = F.sum(a * b)
        sums[f"_b{i}"] = F.sum(a * value)
    rows = [F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for j in range(len(basis))], F.col(f"_b{i}")) for i in range(len(basis))]
    return sums, F.array(*rows)
