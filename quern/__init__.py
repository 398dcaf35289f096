"""Quality-constrained asset selection as PySpark DataFrame plans."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Let Python workers on this machine import the package from where the driver has it; a cluster ships it with --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
