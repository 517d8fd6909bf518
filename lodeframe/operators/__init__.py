"""Panel operators: transforms, returns, portfolios, information coefficients, regressions."""
