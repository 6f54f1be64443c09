"""Scoring and token parameters with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class Params:
    robs: float = 0.0178
    robx: float = 0.52
    min_dev: float = 0.375
    spam_cutoff: float = 0.99
    ham_cutoff: float = 0.45  # 0: two states
    sp_esf: float = 1.0
    ns_esf: float = 1.0
    min_token_len: int = 3
    max_token_len: int = 30
    token_count_fix: int = 0
    token_count_min: int = 0
    token_count_max: int = 0
    thresh_update: float = 0.0
    multi_token_count: int = 1  # longest n-gram of tokens
    header_line_markup: bool = True  # tag the tokens of headers
    block_on_subnets: bool = False  # addresses with their subnets
    replace_nonascii: bool = False
    wordlist_version: int = 20040500  # older ones tag addresses url: instead of ip:
    tags: tuple[str, str, str] = ("Spam", "Ham", "Unsure")

    def __post_init__(self):
        if self.token_count_fix and (self.token_count_min or self.token_count_max):
            raise ValueError("a fixed token count excludes a minimum or maximum")
        if self.token_count_max and self.token_count_min > self.token_count_max:
            raise ValueError("the minimum token count is above the maximum")


def _value(like, text: str):
    if isinstance(like, bool):
        return text.lower() in ("1", "y", "yes", "t", "true", "on")
    return type(like)(float(text))


def parse(lines: list[str], base: Params = Params()) -> Params:
    """key=value settings; '#' starts a comment, case and '-' for '_' make no difference, unknown keys are ignored, zero robs or robx mean the default."""
    found = {}
    for line in lines:
        name, sep, value = line.partition("#")[0].partition("=")
        name = name.strip().lower().replace("-", "_")
        if sep and name in Params.__dataclass_fields__ and name != "tags":
            found[name] = _value(getattr(base, name), value.strip()) if value.strip() else getattr(base, name)
    for name in ("robs", "robx"):
        if found.get(name) == 0:
            found[name] = getattr(Params(), name)
    return replace(base, **found)


def from_table(params: DataFrame, base: Params = Params()) -> Params:
    """Settings from a table (param_name, param_value), a handful of rows."""
    return parse([f"{r['param_name']}={r['param_value']}" for r in params.collect() if r["param_name"] and r["param_value"] is not None], base)
