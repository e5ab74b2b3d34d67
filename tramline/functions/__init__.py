"""Column functions: no function here runs Python on the executors."""

from .geometry import haversine_m, point_in_polygon  # noqa: F401
from .network import *  # noqa: F401,F403
from .random import hash_uniform, noise_multiplier  # noqa: F401
from .traffic import *  # noqa: F401,F403
