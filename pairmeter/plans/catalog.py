"""All registered queries. Importing a query module registers its entries."""

from pairmeter.plans import q_audits, q_clusters, q_extract, q_folds, q_intervals, q_models, q_stats, q_uncertainty, q_verdicts  # noqa: F401
from pairmeter.plans.registry import ORACLES, QUERIES  # noqa: F401
