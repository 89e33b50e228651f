"""Search configurations: sections of keys, and keys with a name in braces as maps."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field


def parse_config(text: str) -> dict[str, str]:
    """'[Section]Key' -> value. # begins a comment anywhere; of a key defined twice the first counts."""
    out: dict[str, str] = {}
    section = ""
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if line.startswith("[") and line.endswith("]"):
            section = line
        elif "=" in line:
            key, _, value = line.partition("=")
            out.setdefault(section + key.strip(), value.strip())
    return out


def named_values(config: Mapping[str, str], key: str) -> dict[str, str]:
    """Values of '[Section]Key{name}' by name."""
    found = re.compile(re.escape(key) + r"\{(.*)\}$")
    return {m[1]: v for k, v in config.items() if (m := found.match(k))}


def numbers(value: str) -> list[float]:
    return [float(x) for x in value.split(",") if x.strip()]


@dataclass(frozen=True)
class SearchConfig:
    """What a search needs, with the usual defaults."""

    search_name: str = "search"
    search_type: str = "Regular"
    mass_windows: tuple[int, ...] = (0,)
    parent_tolerance: float = 0.05
    fragment_tolerance: float = 0.02
    shortest: int = 7
    longest: int = 60
    missed: int = 2
    most_ptms: int = 0
    cleave_after: str = "KR"
    cleave_before: str = "ACDEFGHIJKLMNPQRSTVWY"
    first_methionine: bool = True
    ptms: Mapping[str, str] = field(default_factory=dict)
    losses: Mapping[str, str] = field(default_factory=dict)
    residues: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    elements: Mapping[str, tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=dict)

    @property
    def high_resolution(self) -> bool:
        return self.fragment_tolerance < 0.1


def search_config(text: str) -> SearchConfig:
    c = parse_config(text)
    p = "[Peptide_Identification]"

    def get(*keys: str, default: str) -> str:
        return next((c[p + k] for k in keys if p + k in c), default)

    ptm = named_values(c, f"{p}PTM")
    kind = get("Search_Type", default="Regular")
    masses, shares = named_values(c, f"{p}Element_Masses"), named_values(c, f"{p}Element_Percent")
    return SearchConfig(
        search_name=get("Search_Name", default="search"),
        search_type=kind,
        mass_windows=tuple(int(x) for x in numbers(get("Parent_Mass_Windows", default="0"))),
        parent_tolerance=float(get("Search_Mass_Tolerance_Parent_Ion", "Mass_Tolerance_Parent_Ion", default="0.05")),
        fragment_tolerance=float(get("Mass_Tolerance_Fragment_Ions", default="0.02")),
        shortest=int(get("Minimum_Peptide_Length", default="7")),
        longest=int(get("Maximum_Peptide_Length", default="60")),
        missed=int(get("Maximum_Missed_Cleavages", default="2")),
        most_ptms=int(get("Max_PTM_Count", default="0")) if kind == "Regular" else 0,
        cleave_after=get("Cleave_After_Residues", default="KR"),
        cleave_before=get("Cleave_Before_Residues", default="ACDEFGHIJKLMNPQRSTVWY"),
        first_methionine=get("Try_First_Methionine", default="true").lower() == "true",
        ptms={k: v for k, v in ptm.items() if "to" not in k},
        losses={a: b for k in ptm if "to" in k for a, b in [k.split("to", 1)]},
        residues={k: tuple(int(x) for x in numbers(v)) for k, v in named_values(c, f"{p}Residue").items()},
        elements={k: (tuple(numbers(v)), tuple(numbers(shares.get(k, "")))) for k, v in masses.items()},
    )


def sweep_configs(template: str, element: str, heavy_index: int, levels: Mapping[str, float], windows: Mapping[str, list[int]]) -> dict[str, str]:
    """A configuration text for each enrichment level: search name, isotope shares and mass windows replaced in the template."""
    out = {}
    for name, share in levels.items():
        text = re.sub(r"(?m)^(\s*Search_Name\s*=).*$", rf"\g<1> {name}", template)
        pair = [1 - share, share] if heavy_index else [share, 1 - share]
        text = re.sub(rf"(?m)^(\s*Element_Percent\{{{re.escape(element)}\}}\s*=).*$", lambda m, pair=pair: f"{m[1]} " + ", ".join(f"{x:.5f}" for x in pair), text)
        if name in windows:
            text = re.sub(r"(?m)^(\s*Parent_Mass_Windows\s*=).*$", lambda m, w=windows[name]: f"{m[1]} " + ",".join(map(str, w)), text)
        out[name] = text
    return out
