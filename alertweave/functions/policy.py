"""What a prediction code decides, as one table per way of reading codes.

A reading maps each known code to a decision: null for a reject, else the label
that the code stands for. Codes outside the map either are labels themselves
(`others_are_labels`) or decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertweave.functions import encode as E

#: Codes that always hand the alert to an analyst.
_HANDED_OVER = {E.NOT_CONFIDENT: None, E.UNSEEN_EVENT: None, E.TOO_FAR: None}

ATTACK_ID = {"codes": {**_HANDED_OVER, E.BENIGN_CLUSTER: E.NO_ATTACK}, "others_are_labels": True, "benign": E.NO_ATTACK}
BINARY = {
    "codes": {**_HANDED_OVER, E.CALIBRATED_REJECT: None, 0: 0, E.BENIGN_CLUSTER: 0, 1: 1},
    "others_are_labels": False,
    "benign": 0,
}


def binary_reading(reject_code: int) -> dict:
    """The binary reading with a reject code of its own; a reject wins over any other meaning of the code."""
    codes = {c: d for c, d in BINARY["codes"].items() if c != E.CALIBRATED_REJECT}
    return {**BINARY, "codes": {**codes, reject_code: None}}


def decided(reading: dict, code: Column) -> Column:
    """The decided label of a code, null where nothing is decided."""
    table = F.create_map(*[F.lit(x) for pair in reading["codes"].items() if pair[1] is not None for x in pair])
    known = F.try_element_at(table, code)
    rejected = code.isin([c for c, d in reading["codes"].items() if d is None])
    label = F.coalesce(known, F.when(code >= 0, code)) if reading["others_are_labels"] else known
    return F.when(~rejected, label).cast("int")


def is_alarm(reading: dict, decision: Column) -> Column:
    return decision != reading["benign"]


def truth_for(reading: dict, label: Column) -> Column:
    """Attack labels as the reading's decisions name them."""
    return label if reading["others_are_labels"] else (label != E.NO_ATTACK).cast("int")


def tri_state(prediction: Column) -> Column:
    return F.when(prediction > 0, "Incident").when(prediction == 0, "Non-Incident").otherwise("Reject")
