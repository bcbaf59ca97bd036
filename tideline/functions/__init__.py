"""Column functions: numbers, time, imbalances, decision rules."""

from tideline.functions.scalar import *  # noqa: F403
