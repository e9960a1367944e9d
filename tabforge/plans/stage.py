"""Fitted stages: plain JSON parameters plus an ``apply`` that only adds column expressions.

A Stage is what every ``fit_*`` returns. ``apply`` never re-fits, so replaying the stages
on raw rows gives exactly the table the fit produced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_APPLY = {}


def register(kind: str):
    def deco(fn):
        _APPLY[kind] = fn
        return fn
    return deco


@dataclass
class Stage:
    kind: str
    params: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind not in _APPLY:
            raise KeyError(f"no apply registered for stage kind {self.kind!r}")
        return _APPLY[self.kind](df, self.params)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "params": self.params}, sort_keys=True, default=float)

    @staticmethod
    def from_json(text: str) -> "Stage":
        d = json.loads(text)
        return Stage(d["kind"], d["params"])
