"""A year that the given tables do not hold is monitored like the others."""

from __future__ import annotations

import os

import pytest

from steadfold import plans

from .oracle import compare, duck

NAMES = ["mon2_ks", "mon3_wasserstein", "mon6_prediction_shift", "mon7_psi_categorical", "mon10_label_shift", "mon10_class_shares",
         "mon12_shift_verdict"]


@pytest.fixture(scope="module")
def later(tmp_path_factory, sf_dir):
    """The tables with the rows of 2001 once more in 2002 and 2004."""
    folder = str(tmp_path_factory.mktemp("later"))
    for f in os.listdir(sf_dir):
        if f != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{f}", f"{folder}/{f}")
    copies = "".join(f" UNION ALL SELECT * REPLACE (l_shipdate + INTERVAL {n} YEAR AS l_shipdate, l_tax / {n + 1} AS l_tax) FROM lineitem WHERE year(l_shipdate) = 2001"
                     for n in (1, 3))
    duck(sf_dir).execute(f"COPY (SELECT * FROM lineitem{copies}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_other_years_stay(spark, later, name):
    assert {r["year"] for r in plans.queries()[name](spark, later).collect()} == {*range(1996, 2003), 2004}
    assert compare(spark, duck(later), name, plans.queries()[name], plans.oracle_sql()[name], later) is None
