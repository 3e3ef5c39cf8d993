"""A caller's own labels and spellings."""

import pytest

from flowlens.functions.vocab import LABELS, PUBLISHED, Vocabulary
from flowlens.operators import labels

OWN = Vocabulary(("calm", "storm", "quake"), "calm", {"Sturm": "storm", "S.T.O.R.M": "storm", "erd-beben": "quake"})


def test_own_labels_and_spellings(spark):
    rows = [(i, t) for i, t in enumerate(["Calm ", "STURM", "s t o r m", "Erd – Beben", "ｓｔｏｒｍ", "quake"])]
    found = labels.label_rows(spark.createDataFrame(rows, "row_id long, label string"), known=OWN).orderBy("row_id").collect()
    assert [(r["label"], r["label_binary"], r["label_multiclass"]) for r in found] == [
        ("calm", 0, 0), ("storm", 1, 1), ("storm", 1, 1), ("quake", 1, 2), ("storm", 1, 1), ("quake", 1, 2)]
    named = labels.add_names(spark.createDataFrame([(2,), (7,)], "k int"), "k", "name", OWN).collect()
    assert {r["k"]: r["name"] for r in named} == {2: "quake", 7: "7"}
    used = labels.used_mapping(spark.createDataFrame([("storm",), ("storm",)], "label string"), known=OWN).collect()
    assert {r["label"]: r["rows"] for r in used} == {"calm": 0, "storm": 2, "quake": 0}


def test_unknown_labels_are_counted_in_all(spark):
    rows = [(f"strange {i}",) for i in range(60) for _ in range(1 + i % 2)] + [("storm",), (None,)]
    df = spark.createDataFrame(rows, "label string")
    with pytest.raises(ValueError, match="91 rows with 61 missing or unknown labels"):
        labels.check_labels(df, known=OWN)
    assert labels.unknown_labels(df, known=OWN).count() == 60


def test_contradictions_are_refused():
    assert PUBLISHED.labels == LABELS
    for wrong in ((("a", "b"), "c", {}), (("a", "a"), "a", {}), (("a", "b"), "a", {"x": "y"}), (("a", "b"), "a", {"B": "a"})):
        with pytest.raises(ValueError):
            Vocabulary(*wrong)
