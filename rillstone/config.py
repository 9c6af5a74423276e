"""Settings: defaults, the compact preset, and a ``key = value`` file format."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    template_capacity: int = 256
    flow_capacity: int = 65_536
    flow_idle_ticks: int = 30_000
    window_size: int = 4096
    max_fragments: int = 256
    aggregate: bool = True
    strict_types: bool = False


#: For small sessions.
COMPACT = Config(template_capacity=8, flow_capacity=1024, window_size=1024, max_fragments=32)

WORDS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


def parse(text: str, base: Config = Config()) -> Config:  # noqa: B008  (frozen)
    """Lines of ``key = value``; ``#`` and ``;`` start comments, numbers may be hexadecimal, unknown keys pass."""
    kinds = {f.name: f.type for f in fields(Config)}
    found: dict[str, object] = {}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        key, sign, value = (x.strip() for x in line.partition("="))
        if not sign:
            raise ValueError(f"line {n}: no '='")
        if kinds.get(key) == "bool":
            if value not in WORDS:
                raise ValueError(f"line {n}: {value!r} is no yes or no")
            found[key] = WORDS[value]
        elif key in kinds:
            found[key] = int(value, 16) if value.startswith("0x") else int(value)
    return replace(base, **found)
