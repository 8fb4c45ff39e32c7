"""Readers, writers and the durable layouts behind them."""
