"""Old names of functions and queries, which still work and say what to use."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from typing import Any

from tidegrain.functions import rules, text
from tidegrain.operators import stats

#: Old name, new name and function.
FUNCTIONS: dict[str, tuple[str, Callable[..., Any]]] = {
    "fn_normalizar_nome_produto": ("text.name_key", text.name_key),
    "fn_sanitizar_nome_produto": ("text.name_key", text.name_key),
    "fn_estatisticas_volatilidade_24m": ("stats.volatility", stats.volatility),
    "fn_status_cor_zscore": ("rules.sigma_band", rules.sigma_band),
    "fn_status_cor_regra_15": ("rules.band", lambda price, reference: rules.band(price, reference, 15)),
    "fn_status_cor_regra_25": ("rules.band", lambda price, reference: rules.band(price, reference, 25)),
}

#: Queries whose names were longer once.
QUERIES = {f"{name}_all": name for name in ("b15_valid_rows", "f4_null_order", "f9_status_order", "h1_decimal_price", "h4_name_key")}


def function(old: str) -> Callable[..., Any]:
    """The function of an old name; a call warns."""
    new, f = FUNCTIONS[old]

    def renamed(*args, **more):
        warnings.warn(f"{old} is now {new}", DeprecationWarning, stacklevel=2)
        return f(*args, **more)

    return renamed


def query(name: str) -> str:
    """A query's name today."""
    if name in QUERIES:
        warnings.warn(f"{name} is now {QUERIES[name]}", DeprecationWarning, stacklevel=2)
    return QUERIES.get(name, name)
