"""factlake: Spark operators over fact tables (corpora, edge lists, event logs, text columns).

Every public operator takes and returns DataFrames.  See README.md for the operator index.
"""
