"""Pages from the stored layout are those of the whole table, and skip what they do not need."""

import itertools

import numpy as np
import pytest

from flowlens.operators import pages, views


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = [(i * 3, ["Normal", "Suspicious", "Attack"][int(k)], ["BENIGN", "DDoS", "Bot"][int(c)], float(r))
            for i, (k, c, r) in enumerate(zip(rng.integers(0, 3, 6000), rng.integers(0, 3, 6000), rng.uniform(0, 100, 6000), strict=True))]
    df = spark.createDataFrame(rows, "stream_order long, alert_level string, predicted_multiclass_label_name string, risk_score double")
    made = pages.PageStore(spark, str(tmp_path_factory.mktemp("pages")))
    made.write(df.repartition(5))
    return made, df


def test_pages_of_the_store(store, monkeypatch):
    made, df = store
    for at_once, level, kind, risk, after, (limit, offset) in itertools.product(
            (1, 64), (None, "Attack"), (None, "DDoS"), (None, 90.0), (None, 9000), ((50, 0), (700, 120), (10, 5990))):
        monkeypatch.setattr(pages, "BLOCKS_AT_ONCE", at_once)
        if (level is None) != (risk is None) and after is None:
            continue  # half of the cases will do
        want = views.page(df, limit, offset, level, kind, risk, after).orderBy("stream_order").collect()
        got = made.page(limit, offset, level, kind, risk, after).orderBy("stream_order").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want], (at_once, level, kind, risk, after, limit, offset)


def test_no_page_of_nothing(store):
    made, _ = store
    assert made.page(10, attack_type="Unknown").count() == 0 and made.page(10, after=10**9).count() == 0


def test_a_deep_page_reads_few_rows(spark, store, monkeypatch):
    """The offset passes whole blocks: the range read starts behind them."""
    made, _ = store
    seen = {}
    between = pages.PageStore._between
    monkeypatch.setattr(pages.PageStore, "_between", lambda self, kept: seen.update(kept) or between(self, kept))
    assert made.page(10, 5000).count() == 10
    assert min(seen) > 0 and sum(n for n, _, _ in seen.values()) < 6000
