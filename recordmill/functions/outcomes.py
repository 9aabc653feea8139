"""Classification of attempts: retry or not, and the class of the answer."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import contract as C


def is_retryable(flag: Column, status: Column, code: Column) -> Column:
    """An error's own flag decides where it has one; otherwise its status or socket code."""
    transient = (status == 429) | (status >= 500)
    return F.coalesce(
        flag, F.coalesce(transient, F.lit(False)) | F.coalesce(code.isin(C.TRANSIENT_CODES), F.lit(False))
    )


def outcome_class(code: Column, flag: Column, status: Column) -> tuple[Column, Column]:
    """``(answer status, retryable)`` of a failed event."""
    permanent = F.coalesce(code.isin(C.VALIDATION_ERROR, C.MISSING_REFERENCE), F.lit(False))
    retry = ~permanent & (
        F.coalesce(flag, F.lit(False)) | (F.coalesce(status, F.lit(500)) >= 500)
    )
    answer = F.when(~retry, F.lit(400)).when(status == 429, F.lit(429)).otherwise(F.lit(503))
    return answer, retry
