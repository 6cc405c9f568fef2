"""Investment comparables meet on addresses within price bands only."""

from __future__ import annotations

from parcelforge.operators import blocking, dedup


def test_addresses_of_other_prices_are_no_candidates(spark, monkeypatch):
    """All share words, borders and most letters; of 60 rows each price has two, and one pair lies over the border of two bands."""
    rows = [(i, f"{i + 1} Oak Mill Crescent, Ashby", 1e5 * 1.2 ** (i // 2) * (1.04 if i % 2 else 1), "2024 Q1") for i in range(60)]
    counts, real = [], dedup.name_candidates

    def counted(*args, **more):
        out = real(*args, **more)
        counts.append(out.count())
        return out

    monkeypatch.setattr(dedup, "name_candidates", counted)
    df = spark.createDataFrame(rows, "row_no bigint, address string, price double, quarter string")
    got = sorted(tuple(r) for r in dedup.investment_pairs(df).collect())
    assert got == [(i, i + 1) for i in range(0, 60, 2)]
    assert counts[0] <= 60 * 3  # 3,540 of all prices


def test_the_parts_keep_to_the_bands_too(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1, "Oak Mill Yard", 1), (2, "Oak Mill Yard Ashby", 1), (3, "Oak Mill Yard Bath", 5)], "id int, name string, p int")
    meet = (F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1), F.col("p"))
    for f in (lambda: blocking._overlaps(d, d, 0.6, meet), lambda: blocking._contained(d, d, meet)):
        assert {tuple(sorted(r)) for r in f().collect() if r[0] != r[1]} == {(1, 2)}
