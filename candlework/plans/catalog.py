"""Every query of the library by name, with its DuckDB SQL."""

from __future__ import annotations

from candlework.plans import assets, derivatives, equities, followup, ledger, miner, patterns, tiers

QUERIES = equities.QUERIES | assets.QUERIES | derivatives.QUERIES | patterns.QUERIES | ledger.QUERIES | miner.QUERIES | followup.QUERIES | tiers.QUERIES
ORACLE_SQL = equities.ORACLE_SQL | assets.ORACLE_SQL | derivatives.ORACLE_SQL | patterns.ORACLE_SQL | ledger.ORACLE_SQL | miner.ORACLE_SQL | followup.ORACLE_SQL | tiers.ORACLE_SQL
