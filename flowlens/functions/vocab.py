"""Label vocabulary, aliases, severities and threat descriptors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowlens.functions.local import local_table

BENIGN = "BENIGN"

# The ordered label vocabulary; the position is the multiclass id.
LABELS = (
    "BENIGN",
    "Bot",
    "DDoS",
    "DoS GoldenEye",
    "DoS Hulk",
    "DoS Slowhttptest",
    "DoS slowloris",
    "FTP-Patator",
    "Heartbleed",
    "Infiltration",
    "PortScan",
    "SSH-Patator",
    "Web Attack - Brute Force",
    "Web Attack - Sql Injection",
    "Web Attack - XSS",
)

# Risk severity per label. A label outside the table weighs 0.75.
SEVERITY = {
    "BENIGN": 0.0,
    "Bot": 0.72,
    "DDoS": 0.98,
    "DoS GoldenEye": 0.92,
    "DoS Hulk": 0.95,
    "DoS Slowhttptest": 0.85,
    "DoS slowloris": 0.84,
    "FTP-Patator": 0.70,
    "Heartbleed": 1.00,
    "Infiltration": 0.97,
    "PortScan": 0.68,
    "SSH-Patator": 0.74,
    "Web Attack - Brute Force": 0.78,
    "Web Attack - Sql Injection": 0.99,
    "Web Attack - XSS": 0.80,
}
DEFAULT_SEVERITY = 0.75

# Family, tactic, severity tier, playbook, response scope per label.
DESCRIPTOR_FIELDS = ("threat_family", "mitre_tactic", "severity_tier", "response_playbook", "response_scope")
DESCRIPTORS = {
    "BENIGN": ("Normal Traffic", "None", "Informational",
               "Continue monitoring with normal telemetry retention.", "none"),
    "Bot": ("Botnet Activity", "Command and Control", "High",
            "Quarantine the suspected source and inspect lateral communication paths.", "source_file"),
    "DDoS": ("Availability Disruption", "Impact", "Critical",
             "Trigger containment workflow and rate-limit the targeted service or port.", "destination_port"),
    "DoS GoldenEye": ("Availability Disruption", "Impact", "High",
                      "Rate-limit the impacted service and inspect connection saturation behavior.",
                      "destination_port"),
    "DoS Hulk": ("Availability Disruption", "Impact", "Critical",
                 "Throttle aggressive flows and isolate the affected service tier.", "destination_port"),
    "DoS Slowhttptest": ("Availability Disruption", "Impact", "High",
                         "Apply slow-connection mitigations and investigate application timeouts.",
                         "destination_port"),
    "DoS slowloris": ("Availability Disruption", "Impact", "High",
                      "Block abusive session patterns and inspect reverse proxy protections.",
                      "destination_port"),
    "FTP-Patator": ("Credential Abuse", "Brute Force", "High",
                    "Lock down the targeted authentication surface and rotate exposed credentials.",
                    "source_file"),
    "Heartbleed": ("Memory Disclosure", "Collection", "Critical",
                   "Escalate immediately, patch vulnerable services, and capture memory-forensics artifacts.",
                   "flow_signature"),
    "Infiltration": ("Lateral Movement / Exfiltration", "Exfiltration", "Critical",
                     "Isolate the suspected host path, preserve traffic captures, and inspect outbound data movement.",
                     "source_file"),
    "PortScan": ("Reconnaissance", "Discovery", "Medium",
                 "Escalate to perimeter monitoring and suppress repeated probing against exposed ports.",
                 "destination_port"),
    "SSH-Patator": ("Credential Abuse", "Brute Force", "High",
                    "Investigate repeated SSH failures and apply temporary access controls to the source.",
                    "source_file"),
    "Web Attack - Brute Force": ("Web Exploitation", "Initial Access", "High",
                                 "Throttle the targeted endpoint, preserve HTTP context, and inspect auth controls.",
                                 "flow_signature"),
    "Web Attack - Sql Injection": ("Web Exploitation", "Initial Access", "Critical",
                                   "Isolate the affected application path and inspect database query surfaces immediately.",
                                   "flow_signature"),
    "Web Attack - XSS": ("Web Exploitation", "Initial Access", "High",
                         "Inspect the targeted route, sanitize payload handling, and validate session integrity.",
                         "flow_signature"),
}
DEFAULT_DESCRIPTOR = ("Unknown Attack", "Unknown", "High",
                      "Escalate to analyst review and preserve full packet context for triage.", "flow_signature")
NOVEL_RECON = ("Novel Reconnaissance", "Discovery", "High",
               "Preserve packet context and suppress the scanning surface with temporary access controls.",
               "destination_port")
NOVEL_FLOOD = ("Novel Availability Disruption", "Impact", "Critical",
               "Throttle the suspected service path and inspect flood-style burst behavior immediately.",
               "destination_port")
NOVEL_EXPLOIT = ("Novel Exploitation", "Initial Access", "High",
                 "Escalate to application triage, capture payload context, and isolate the affected flow signature.",
                 "flow_signature")
NOVEL_OTHER = ("Novel Suspicious Activity", "Execution", "High",
               "Escalate to analyst review and quarantine the flow signature until classified.", "flow_signature")

LEVELS = ("Normal", "Suspicious", "Attack")


def alias_key(label: str) -> str:
    """Lower case, every run of other characters one space."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in label.lower())
    return " ".join(words.split())


# Each label is found by its own key.
ALIASES = {alias_key(label): label for label in LABELS}


@dataclass(frozen=True)
class Vocabulary:
    """The labels a caller knows, in the order of their multiclass ids, the benign one, and other spellings of them."""

    labels: tuple[str, ...] = LABELS
    benign: str = BENIGN
    aliases: Mapping[str, str] = field(default_factory=dict)  # spelling -> label

    def __post_init__(self):
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("labels must differ")
        if self.benign not in self.labels:
            raise ValueError(f"the benign label {self.benign!r} is none of the labels")
        lost = sorted(set(self.aliases.values()) - set(self.labels))
        if lost:
            raise ValueError(f"aliases of labels that are not listed: {lost}")
        keys: dict[str, str] = {}
        for spelling, label in [*((x, x) for x in self.labels), *self.aliases.items()]:
            if keys.setdefault(alias_key(spelling), label) != label:
                raise ValueError(f"{spelling!r} stands for {label!r} and {keys[alias_key(spelling)]!r}")

    def keys(self) -> dict[str, str]:
        return {alias_key(x): label for x, label in [*((x, x) for x in self.labels), *self.aliases.items()]}

    def alias_dim(self, spark: SparkSession) -> DataFrame:
        """alias_key, label: one row per spelling."""
        return local_table(spark, list(self.keys().items()), "alias_key string, label string")

    def label_dim(self, spark: SparkSession) -> DataFrame:
        """label, label_binary, label_multiclass: one row per label."""
        rows = [(label, int(label != self.benign), i) for i, label in enumerate(self.labels)]
        return local_table(spark, rows, "label string, label_binary tinyint, label_multiclass smallint")


PUBLISHED = Vocabulary()


def severity_dim(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(SEVERITY.items()), "predicted_multiclass_label_name string, severity double")


def descriptor_dim(spark: SparkSession) -> DataFrame:
    rows = [(label, *fields) for label, fields in DESCRIPTORS.items()]
    schema = "predicted_multiclass_label_name string, " + ", ".join(f"{f} string" for f in DESCRIPTOR_FIELDS)
    return local_table(spark, rows, schema)
