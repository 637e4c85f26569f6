"""Column builders for keys, labels and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector prefixes, attack stages, score codes and their meanings.
DETECTORS = {"A": "AMiner", "S": "Suricata", "W": "Wazuh"}

ATTACK_STAGES = {
    "dns_scan": "network_scans",
    "service_scan": "service_scans",
    "wpscan": "wpscan",
    "dirb": "dirb",
    "webshell_cmd": "webshell",
    "crack_passwords": "cracking",
    "online_cracking": "cracking",
    "attacker_change_user": "privilege_escalation",
    "escalated_sudo_command": "privilege_escalation",
    "dnsteal": "dnsteal",
}

NO_ATTACK = -1
NOT_CONFIDENT = -1
UNSEEN_EVENT = -2
TOO_FAR = -3
BENIGN_CLUSTER = -4
CALIBRATED_REJECT = -5
UNLABELLED = -9
NO_EVENT_ORIGINAL_ID = -1337

SCORE_MEANINGS = {
    -5: "calibrated reject",
    -4: "benign cluster",
    -3: "too far from the nearest cluster",
    -2: "event not seen in training",
    -1: "not confident",
}


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def epoch_seconds(iso: Column) -> Column:
    """Epoch seconds of an ISO-8601 string, fraction kept; null when malformed."""
    return F.unix_micros(F.try_to_timestamp(iso)) / F.lit(1_000_000)


def machine_key(scenario: Column, host: Column, separator: str = "::") -> Column:
    return F.concat(scenario, F.lit(separator), host)


def scenario_of(machine: Column) -> Column:
    """Text before the last underscore, the whole string if there is none."""
    return F.regexp_replace(machine, "_[^_]*$", "")


def detector_of(event_key: Column, table: dict[str, str] | None = None) -> Column:
    """Detector name from the first letter; null (see the domain check) when unknown."""
    return F.try_element_at(_lookup(table or DETECTORS), F.substring(event_key, 1, 1))


def event_incident(event_label: Column) -> Column:
    return F.when(event_label != "-", 1).otherwise(0)


def window_incident(time_label: Column) -> Column:
    return F.when(time_label != "false_positive", 1).otherwise(0)


def incident_group(scenario: Column, incident: Column, step: Column, stages: dict[str, str] | None = ATTACK_STAGES) -> Column:
    """`scenario::stage` for incidents, null otherwise; `stages=None` keeps the step name."""
    stage = step if stages is None else F.coalesce(F.try_element_at(_lookup(stages), step), F.lit("unmapped"))
    return F.when(incident == 1, F.concat_ws("::", scenario, stage))


def score_meaning(score: Column) -> Column:
    return (
        F.when(score >= 0, F.lit("attack id"))
        .otherwise(F.coalesce(F.try_element_at(_lookup(SCORE_MEANINGS), score.cast("int")), F.lit("unknown code")))
    )


def binary_truth(label: Column) -> Column:
    return F.when(label == NO_ATTACK, 0).otherwise(1)


def original_event_id(internal: Column, original: Column, pad_id: int | Column) -> Column:
    """Original id of an internal id after a left join on the mapping; identity fallback."""
    return F.when(internal == pad_id, F.lit(NO_EVENT_ORIGINAL_ID)).otherwise(F.coalesce(original, internal))
