"""Configuration files (TOML): resolution rules, blocking, thresholds and survivorship policy. Unknown fields are refused, and values are never echoed."""

from __future__ import annotations

import os
import tomllib

from bitempo.operators.resolve import Blocking, Rule, Ruleset
from bitempo.operators.survivorship import Policy, Strategy

#: The file's keys, and the numbers that are shipped in it.
TEMPLATE = """\
[index]
dim = 64
metric = "cosine"

[resolution]
review_at = 5.2439
match_at = 7.2439

[[resolution.field]]
field = "name"
comparator = "possessive_aware"
m = 0.9
u = 0.01

[[resolution.field]]
field = "kind"
comparator = "exact"
m = 0.9
u = 0.38

[[resolution.blocking]]
kind = "prefix"
field = "name"
n = 3

[policy]
default = "most_recent"

[policy.attribute]
employer = "valid_interval"
"""

COMPARATORS = ("exact", "normalized", "jaro_winkler", "token_jaccard", "possessive_aware")
METRICS = ("cosine", "l2")
KNOWN = {"": {"index", "resolution", "policy", "provider"}, "provider": {"base_url", "api_key_env", "completion_model", "embedding_model"}, "index": {"dim", "metric"}, "resolution": {"review_at", "match_at", "field", "blocking"}, "policy": {"default", "attribute"}, "field": {"field", "comparator", "m", "u"}, "blocking": {"kind", "field", "n"}}


class ConfigError(ValueError):
    """Names the place of a mistake, not its value."""


def _only(part: str, fields) -> None:
    strange = sorted(set(fields) - KNOWN[part])
    if strange:
        raise ConfigError(f"unknown field {strange[0]} in {part or 'the file'}")


def strategy(name: str) -> Strategy:
    found = {s.value: s for s in Strategy if s is not Strategy.SOURCE_PRIORITY}.get(name)
    if found is None:
        raise ConfigError("no such strategy")
    return found


class Config:
    def __init__(self, text: str):
        try:
            raw = tomllib.loads(text)
        except tomllib.TOMLDecodeError as e:
            raise ConfigError("not a TOML file") from e
        _only("", raw)
        index, resolution, policy = raw.get("index", {}), raw.get("resolution", {}), raw.get("policy", {})
        _only("index", index)
        _only("resolution", resolution)
        _only("policy", policy)
        provider = raw.get("provider")
        self.provider = None
        if provider is not None:
            _only("provider", provider)
            try:
                # the file names the variable that holds the key, never the key
                self.provider = {"base_url": provider["base_url"], "api_key": os.environ.get(provider["api_key_env"], ""), "completion_model": provider["completion_model"], "embedding_model": provider["embedding_model"]}
            except KeyError as e:
                raise ConfigError(f"provider lacks {e.args[0]}") from None
        self.dim, self.metric = index.get("dim", 64), index.get("metric", "cosine")
        if self.metric not in METRICS or self.dim < 1:
            raise ConfigError("no such index")
        rules, blocking = [], []
        for f in resolution.get("field", []):
            _only("field", f)
            if f.get("comparator") not in COMPARATORS:
                raise ConfigError("no such comparator")
            rules.append(Rule(f["field"], f["comparator"], f["m"], f["u"]))
        for b in resolution.get("blocking", []):
            _only("blocking", b)
            if b.get("kind") not in ("exact", "prefix", "token"):
                raise ConfigError("no such blocking")
            blocking.append(Blocking(b["kind"], b["field"], b.get("n", 0)))
        self.ruleset = Ruleset(tuple(rules), tuple(blocking), resolution["review_at"], resolution["match_at"])
        self.policy = Policy(strategy(policy.get("default", "most_recent")), {a: strategy(s) for a, s in policy.get("attribute", {}).items()})
