"""tillcycle — a retail operating cycle expressed as Spark DataFrame jobs.

Every public function takes DataFrames (plus plain parameters) and returns
DataFrames.  Nothing is collected to the driver inside an operator; the
caller decides when to act (write, count, collect a report edge).
"""

from tillcycle.params import RunParams

__all__ = ["RunParams"]
