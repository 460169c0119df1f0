"""Classification, redaction and screening of text in flight.

The batch operators keep no state, so they run on streams as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import levels as L
from wardline.operators.screening import screen
from wardline.operators.transfer import govern


def govern_and_screen(stream: DataFrame, text: str, ceiling: str, mode: str = "REDACT",
                      block_on: int = L.HIGH) -> DataFrame:
    """Add governed text and the injection assessment; rows to quarantine are marked."""
    governed = govern(screen(stream, text, block_on), text, ceiling, mode)
    return governed.withColumn("quarantine", F.col("assessment.should_block") | F.col("blocked"))
