"""All SQL counterparts by query name."""

from registry.oracle_marts import ORACLES as MART_ORACLES
from registry.oracle_models import ORACLES as MODEL_ORACLES
from registry.oracle_questions import ORACLES as QUESTION_ORACLES

ORACLES: dict[str, str] = {**QUESTION_ORACLES, **MART_ORACLES, **MODEL_ORACLES}
