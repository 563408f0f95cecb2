"""Named queries: importing the modules fills the registry."""

from coverlens.plans import belief, experiments, exposure, inference, priors, streams  # noqa: F401
from coverlens.plans.registry import ORACLE, QUERIES  # noqa: F401
