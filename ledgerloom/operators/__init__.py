"""DataFrame operators: classify, segment, extract, rebuild ledgers, normalise, validate, decide entitlements."""
