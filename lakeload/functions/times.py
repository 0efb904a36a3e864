"""Load timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone and text form of the time stored with every load.
LOAD_ZONE = "America/Sao_Paulo"
LOAD_FORMAT = "yyyy-MM-dd HH:mm"


def load_timestamp(
    moment: Column | None = None, zone: str = LOAD_ZONE, source_zone: str | None = None
) -> Column:
    """Wall-clock text of a moment in ``zone``; now when no moment is given.

    ``source_zone`` is the zone of a moment without time zone; a TIMESTAMP
    needs none, as the session zone then applies.
    """
    moment = F.current_timestamp() if moment is None else moment
    origin = F.current_timezone() if source_zone is None else F.lit(source_zone)
    local = F.convert_timezone(origin, F.lit(zone), moment.cast("timestamp_ntz"))
    return F.date_format(local, LOAD_FORMAT)
