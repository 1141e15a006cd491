"""claimscope: turn self-reported facility claims into verified, queryable tables.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing is collected to the driver unless its size is checked first.
"""
