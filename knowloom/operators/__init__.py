"""Set-oriented DataFrame operators; every public function maps DataFrames to a DataFrame."""
