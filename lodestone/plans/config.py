"""Index settings and how they are stored."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

#: Key of a stored setting -> field.
STORED = {"M": "m", "efConstruction": "ef_construction", "efSearch": "ef_search", "dim": "dim", "space": "space"}


@dataclass(frozen=True)
class IndexConfig:
    """``m``: neighbours of a node on upper layers (``m0`` on the lowest, twice that if 0); ``ef_*``: beam widths."""

    m: int = 16
    m0: int = 0
    ef_construction: int = 200
    ef_search: int = 50
    dim: int = 384
    space: str = "cosine"
    normalize: bool = True
    seed: int = 0

    def __post_init__(self):
        for name in ("m", "ef_construction", "ef_search", "dim"):
            value = getattr(self, name)
            if type(value) is not int or value < 1:
                raise ValueError(f"{name} must be a whole number of at least 1, not {value!r}")
        if self.m < 2:
            raise ValueError("m must be at least 2: levels are drawn by its logarithm")
        if self.space not in ("cosine", "l2"):
            raise ValueError(f"space must be cosine or l2, not {self.space!r}")
        if not self.m0:
            object.__setattr__(self, "m0", 2 * self.m)

    def dumps(self) -> str:
        return json.dumps({k: getattr(self, f) for k, f in STORED.items()}, indent=2)

    @classmethod
    def loads(cls, text: str, dim: int | None = None) -> IndexConfig:
        """``dim``: what the vectors have; another value in the text is an error."""
        found = json.loads(text)
        if not isinstance(found, dict) or (missing := STORED.keys() - found.keys()):
            raise ValueError(f"settings lack {sorted(missing) if isinstance(found, dict) else 'everything'}")
        config = cls(**{f: found[k] for k, f in STORED.items()})
        if dim is not None and config.dim != dim:
            raise ValueError(f"settings are for {config.dim} components, vectors have {dim}")
        return config

    def fields(self) -> dict:
        return asdict(self)
