"""Land-suitability screening as PySpark jobs.

Every public function takes and returns DataFrames (or Columns); nothing runs
until the caller writes or counts the result, except where a docstring says
that a size is checked first.
"""
