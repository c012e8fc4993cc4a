"""Panel analytics on PySpark: signals, portfolios, simulation, validation and labels."""

from panelloom.operators.signals import compute_signal, register_signal
from panelloom.plans.backtest import backtest
from panelloom.plans.blend import blend_equal_weight, walk_forward
from panelloom.session import local_session

__all__ = ["backtest", "blend_equal_weight", "compute_signal", "local_session", "register_signal", "walk_forward"]
