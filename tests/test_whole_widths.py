"""The kernel width of a probe pair comes from all its cells, however many."""

import numpy as np

from tidewell.operators import design


def test_all_cells_of_a_group_choose_its_width(spark):
    """More cells than 2,000 of a group were sampled."""
    rng = np.random.default_rng(4)
    rows = [(u, k, int(b), 1) for k in range(2600) for u in (1, 2) for b in sorted(rng.choice(40, 3, replace=False))]
    bins = spark.createDataFrame(rows, "unit_id long, trial_id long, bin long, n long")
    pairs = spark.createDataFrame([(1, 2, "all")], "src long, dst long, kind string")
    got = design.pooled_width(bins, pairs, ["kind"], [1.0, 2.0, 6.0], 3, 40).first()
    own = design.best_width(design.width_curve(design.gram(bins, pairs.select("src", "dst"), [1.0, 2.0, 6.0], 3, 40, 2600), 40, 2600)).first()
    assert got.n_cells == 2600 and got.width == own.width
