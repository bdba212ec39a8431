"""Registered queries, one module per group of operators."""

from __future__ import annotations

import importlib

SECTIONS = ("voxel", "fingerprint", "plan", "manifest", "registry", "normalize", "morphology", "patches", "flows")


def load():
    from voxmill.catalog import base
    for section in SECTIONS:
        importlib.import_module(f"voxmill.catalog.{section}")
    return base.QUERIES, base.ORACLES
