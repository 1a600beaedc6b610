"""Trade-performance analytics over a trades table and a trade stream.

Every public function takes DataFrames and returns a DataFrame; nothing is collected.
"""
