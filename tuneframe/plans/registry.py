"""Imports every query module so their ``@register`` calls run."""

from __future__ import annotations

from . import catalog
from .catalog import finish, round_sql


def _load():
    from . import prep_queries  # noqa: F401

    for mod in ("rollout_queries", "preference_queries", "judge_queries", "misc_queries", "stream_queries",
                "policy_queries", "recipe_queries", "token_queries", "extra_queries"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise


def all_queries():
    _load()
    return dict(catalog.QUERIES)


def all_oracles():
    _load()
    return dict(catalog.ORACLES)


__all__ = ["all_queries", "all_oracles", "finish", "round_sql"]
