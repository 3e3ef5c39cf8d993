"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.functions import vocab
from flowlens.sources import bindings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _text(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value!r}"


def values(rows, names) -> str:
    """Rows as a SQL table expression."""
    body = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else f"{v}e0" if isinstance(v, float) else str(v)
                                     for v in row) + ")" for row in rows)
    return f"(select * from (values {body}) as v({', '.join(names)}))"


SEVERITY_SQL = values(list(vocab.SEVERITY.items()), ("label", "severity"))
LABEL_SQL = values(
    [(key, label, int(label != vocab.BENIGN), vocab.LABELS.index(label)) for key, label in vocab.ALIASES.items()],
    ("alias_key", "label", "label_binary", "label_multiclass"),
)
DESCRIPTOR_SQL = values([(label, *f) for label, f in vocab.DESCRIPTORS.items()], ("label", *vocab.DESCRIPTOR_FIELDS))

SCORED_SQL = f"""
select *, case when risk_score >= 70 then 'Attack' when risk_score >= 40 then 'Suspicious' else 'Normal' end as alert_level,
  risk_score >= 40 as is_alert
from (
  select *, greatest(0e0, least(100e0, 100e0 * (55e-2 * binary_attack_probability + 20e-2 * predicted_attack_severity
      + 15e-2 * attack_class_probability + 10e-2 * disagreement_score))) as risk_score
  from (
    select *, abs(binary_attack_probability - attack_class_probability) as disagreement_score
    from (
      select p.*, coalesce(s.severity, 75e-2) as predicted_attack_severity,
        case when predicted_multiclass_label_name = 'BENIGN' then 0e0 else multiclass_confidence end as attack_class_probability
      from preds p left join {SEVERITY_SQL} s on s.label = p.predicted_multiclass_label_name)))
"""

NEEDS = {"scored": ("preds",)}
TEXTS = {**bindings.TEXTS, "scored": SCORED_SQL}


def define(name: str, text: str, *needs: str) -> None:
    """Name a SQL text so that other texts can use it."""
    TEXTS[name] = text
    NEEDS[name] = needs


def oracle(needs: str, body: str) -> str:
    """SQL text with the named views in front. `body` may start with its own `with`."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in done:
            done.append(name)

    for name in needs.split():
        add(name)
    front = ", ".join(f"{n} as ({TEXTS[n].strip()})" for n in done)
    body = body.strip()
    if body.startswith("with "):
        return f"with {front}, {body[5:]}" if front else body
    return f"with {front} {body}" if front else body
