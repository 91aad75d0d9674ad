"""Composed plans and the registered queries."""

import importlib

PLAN_MODULES = (
    "newsloom.plans.dashboard",
    "newsloom.plans.feed",
    "newsloom.plans.textdedup",
    "newsloom.plans.textq",
    "newsloom.plans.pagesq",
    "newsloom.plans.vectorq",
    "newsloom.plans.datesq",
    "newsloom.plans.ingestq",
    "newsloom.plans.modelq",
    "newsloom.plans.streamq",
    "newsloom.plans.variedq",
    "newsloom.plans.stateq",
)


def load_all() -> None:
    """Import every plan module so its queries register themselves."""
    for name in PLAN_MODULES:
        importlib.import_module(name)
