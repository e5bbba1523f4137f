"""Column-name cleaning."""

from __future__ import annotations

from collections.abc import Iterable


def _drop(name: str, unwanted: str) -> str:
    return "".join(ch for ch in name if ch not in unwanted)


def tag_name(name: str | None) -> str:
    """``#country+code`` to ``country_code``."""
    return _drop((name or "").strip(), "#").replace("+", "_").replace(" ", "_")


def plain_name(name: str | None) -> str:
    return (name or "").strip().replace(" ", "_")


def punctuated_name(name: str | None) -> str:
    """``Total Damage ('000 US$)`` to ``Total_Damage_000_US``."""
    return _drop(plain_name(name).replace("/", "_"), "'()$.,")


def unique_names(names: Iterable[str]) -> list[str]:
    """Repeated names get ``_1``, ``_2``…; a suffix that is taken already is passed over."""
    wanted = list(names)
    taken = set(wanted)
    counts: dict[str, int] = {}
    out = []
    for name in wanted:
        if name not in counts:
            counts[name] = 0
            out.append(name)
            continue
        while True:
            counts[name] += 1
            fresh = f"{name}_{counts[name]}"
            if fresh not in taken:
                break
        taken.add(fresh)
        out.append(fresh)
    return out
