"""Structured Streaming jobs: continuous churn, incremental facts, continuous rules (K1-K6)."""
