"""All queries of the library outside ``llm``, with their SQL."""

from __future__ import annotations

from ledgerlark.plans import assistants, knowledge, market, monitoring, news, operations, planning, risk, services, stores, texts, trading, volatility  # noqa: F401
from ledgerlark.plans.registry import ORACLES, QUERIES  # noqa: F401
