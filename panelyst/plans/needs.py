"""What variables are made from, so that a report links and derives what it reads and nothing else.

``reads`` follows from the catalog alone; no table is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from panelyst.plans import catalog as K

_WORD = re.compile(r"[A-Za-z_]\w*")
_SYNTAX = {"AND", "OR", "NOT", "IS", "NULL", "IN", "BETWEEN"}


def _columns_of(condition: str) -> list[str]:
    """The columns a rule's condition names; text in quotes does not count."""
    return [w for w in _WORD.findall(re.sub(r"'[^']*'", "", condition)) if w not in _SYNTAX]


def flag_groups() -> dict[str, list[str]]:
    """The flags that a summary of a check-box group is made from."""
    flags = [*K.BOX_FLAGS, "DISC_RCD_Missing", "DRUG_RCD_Missing"]
    return {p: [f for f in flags if f.startswith(p)] for p in ("DISC", "DRUG")}


def dummy_names(prefix: str) -> list[str]:
    spec = K.DUMMIES[prefix]
    return [f"{prefix}_{'RCR' if k == spec.reference else 'RCD'}_{k}" for k in spec.levels]


def reads() -> dict[str, list[str]]:
    """Each derived variable with the variables and answers its expression names."""
    out = {"SITE_RC": ["SITE1"]}
    for name, spec in K.RECODES.items():
        out[name] = [spec.source, *([spec.override] if spec.override else [])]
    for name, spec in K.LADDERS.items():
        named = [c for condition, _ in spec.rules for c in _columns_of(condition)]
        out[name] = [*named, *([spec.fallback_column] if spec.fallback_column else [])]
    out |= {
        "AGE_RC": ["TODAY", "DOB"],
        "MONEY_RC": ["MONEY"],
        "MONEY_RC_Log": ["MONEY"],
        "MONEY_RC_Cat": ["MONEY_RC_Log"],
        "TIMESINCEHIV": ["TODAY", "DOB", "DIAGHIV"],
        "BORNHIV_MCD": ["HIVDiagnosisYear_MCD", "DOBY"],
        "TIMESINCEHIV_MCD": ["TODAY", "HIVDiagnosisYear_MCD"],
        "DISC_RCD_Missing": ["DISC"],
        "DRUG_RCD_Missing": ["DRUG1L", "DRUG2L"],
        "DISC_RCD_Anyone": ["DISC_RCR_None"],
        "DRUG_RCD_Uses": ["DRUG_RCR_None"],
    }
    out |= {name: [*spec.boxes, spec.text] for name, spec in K.BOX_FLAGS.items()}
    out |= {name: [*items, *([text] if text else [])] for name, (items, text) in K.OUTCOMES.items()}
    out |= {f"{p}_RCR_None": names for p, names in flag_groups().items()}
    out |= {f"{i}_RC": [i] for s in [*K.SINGLE_ITEMS, *K.SCALES] for i in s.items}
    out |= {s.name: [f"{i}_RC" for i in s.items] for s in K.SCALES}
    out |= {name: [K.DUMMIES[p].source] for p in K.DUMMIES for name in dummy_names(p)}
    return out


def closure(names: Iterable[str]) -> set[str]:
    """``names`` and all that they are made from, answers and facts included."""
    made = reads()
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += made.get(name, ())
    return found
