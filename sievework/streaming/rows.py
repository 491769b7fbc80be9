"""Row-local steps over streams: standard forms, rule failures and masks need no state, so they apply to a stream as to a table.

Repeated rows, shared keys and k-anonymity need all rows; they are left to a batch over what the stream has written.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import POST, Contract
from ..operators.clean import standardise
from ..operators.mask import mask
from ..operators.validate import with_failures


def standardised(stream: DataFrame, contract: Contract, as_of: date) -> DataFrame:
    """Usable rows in standard form with their _changes and _failures."""
    rows = standardise(stream, contract).where(~F.col("_drop")).drop("_drop", "_ambiguous")
    return with_failures(rows, contract, POST, as_of)


def masked(stream: DataFrame, contract: Contract, key: str) -> DataFrame:
    """As over a table: the salt is joined from a one-row table, which no plan shows."""
    return mask(stream, contract, key)
