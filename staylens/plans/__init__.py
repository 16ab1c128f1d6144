"""The registered queries, their SQL twins and the adapter that feeds them."""

from __future__ import annotations

import importlib

_MODULES = ["cleaning_queries", "booking_queries", "prediction_queries", "model_queries", "stream_queries", "training_queries"]


def _load():
    from staylens.plans import catalog

    for module in _MODULES:
        importlib.import_module(f"staylens.plans.{module}")
    return catalog


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
