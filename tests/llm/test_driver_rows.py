"""Near-dedup hands no table to the driver, however small Spark takes it to be."""

import corpus_pipeline as cp
import pytest

from symgraph.llm import common, components, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written, with Spark's own limit for broadcasts."""
    found = []

    def noted(df, *args, **options):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return common.written(df, *args, **options)

    for module in (simhash, components, cp):
        monkeypatch.setattr(module, "written", noted)
    return found


def near_copies(spark):
    word = lambda k: f"word{k * 7919 % 10007}"
    rows = [(40 * a + b, " ".join(word(200 * a + k) for k in range(150)) + f" end{b}", "en", "s", 0) for a in range(6) for b in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_op3_broadcasts_nothing(spark, plans):
    out = simhash.query(near_copies(spark))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len({r.component_id for r in out.collect()}) < 48
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not [p for p in plans if "Broadcast" in p]


def test_near_dedup_stage_broadcasts_nothing(spark, plans):
    out = cp.dedup_near(spark, near_copies(spark), "")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert 0 < out.count() < 48
    assert not [p for p in plans if "Broadcast" in p]
