"""concat_obs and concat_var of either kind of dataset."""

from __future__ import annotations


def _sets(datasets, more) -> list:
    return [*(datasets if isinstance(datasets, (list, tuple)) else [datasets]), *more]


def concat_obs(datasets, *more, **how):
    first, *rest = _sets(datasets, more)
    return first.concat_obs(rest, **how)


def concat_var(datasets, *more, **how):
    first, *rest = _sets(datasets, more)
    return first.concat_var(rest, **how)
