"""Where users add functions, sorters, window functions, aggregators, scorers, text analysis and commands.

Each register_* takes a name and a Python function that makes a Column from Columns (a command: anything),
so what is registered is compiled into the plan like what is built in. Registering a name again replaces it,
and a registered name comes before a built-in one.
"""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("function", "selector", "sorter", "applier", "window_function", "aggregator", "scorer", "tokenizer", "token_filter", "normalizer", "command")
_REGISTERED: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, make: Callable) -> Callable:
    if kind not in _REGISTERED:
        raise ValueError(f"no such kind: {kind}")
    _REGISTERED[kind][name] = make
    return make


def unregister(kind: str, name: str) -> None:
    _REGISTERED[kind].pop(name, None)


def find(kind: str, name: str) -> Callable | None:
    return _REGISTERED[kind].get(name)


def registered(kind: str) -> list[str]:
    return sorted(_REGISTERED[kind])


def register_function(name: str, make: Callable) -> Callable:
    """make(*Columns) -> Column: callable in every script expression."""
    return register("function", name, make)


def register_selector(name: str, make: Callable) -> Callable:
    """make(*Columns) -> boolean Column: a condition; what is null counts as false."""
    return register("selector", name, make)


def register_sorter(name: str, make: Callable) -> Callable:
    """make(*Columns) -> Column: 'name(...)' as a sort key sorts by it, '-name(...)' the other way."""
    return register("sorter", name, make)


def register_applier(name: str, make: Callable) -> Callable:
    """make(*Columns) -> Column: fills a staged column."""
    return register("applier", name, make)


def register_window_function(name: str, make: Callable) -> Callable:
    """make(window, *Columns) -> Column: window has the group and sort keys of the staged column."""
    return register("window_function", name, make)


def register_aggregator(name: str, make: Callable) -> Callable:
    """make(*Columns, **options) -> aggregate Column: callable in the group stage of a facet."""
    return register("aggregator", name, make)


def register_scorer(name: str, make: Callable) -> Callable:
    """make(tf, *Columns) -> Column: tf is how often the term stands in the column."""
    return register("scorer", name, make)


def register_tokenizer(name: str, make: Callable) -> Callable:
    """make(text, **options) -> array of strings."""
    return register("tokenizer", name, make)


def register_token_filter(name: str, make: Callable) -> Callable:
    """make(tokens, **options) -> array of strings."""
    return register("token_filter", name, make)


def register_normalizer(name: str, make: Callable) -> Callable:
    """make(text, **options) -> text."""
    return register("normalizer", name, make)


def register_command(name: str, run: Callable) -> Callable:
    """run(database, **arguments): called by Database.command."""
    return register("command", name, run)
