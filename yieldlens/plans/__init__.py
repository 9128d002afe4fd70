"""Named queries over the test tables; importing this package registers them."""

from . import q_audit, q_cohort, q_labels, q_lookback, q_metrics, q_misc, q_model_frame, q_models, q_report, q_stream  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
