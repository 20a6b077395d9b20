"""Empirical dynamic modelling on Spark DataFrames.

Series live in a long panel ``(sid, t, v)``; every operator is a DataFrame
transformation over that panel, so one call handles one series or millions.
"""

from lagweave.plans.arrays import ccm, ccm_naive, edim, eval_simplex, eval_smap, simplex, smap, xmap
from lagweave.plans.config import engine_config

__version__ = "0.1.0"
__version_info__ = tuple(int(x) for x in __version__.split("."))

__all__ = ["ccm", "ccm_naive", "edim", "engine_config", "eval_simplex", "eval_smap", "simplex", "smap", "xmap"]
