"""Named queries over the provided tables, with equivalent SQL."""

from rubrica.catalog.registry import ORACLES, QUERIES

import rubrica.catalog.check_queries  # noqa: F401,E402
import rubrica.catalog.concept_queries  # noqa: F401,E402
import rubrica.catalog.score_queries  # noqa: F401,E402
import rubrica.catalog.message_queries  # noqa: F401,E402
import rubrica.catalog.report_queries  # noqa: F401,E402
import rubrica.catalog.function_queries  # noqa: F401,E402
import rubrica.catalog.io_queries  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
