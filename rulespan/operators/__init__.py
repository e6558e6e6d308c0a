"""Rule operators: each takes DataFrames and returns a ``RuleResult`` or a DataFrame."""
