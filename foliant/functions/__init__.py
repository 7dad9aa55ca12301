"""Column functions and the vectorised text kernels behind them."""
